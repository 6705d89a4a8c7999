import datetime
import random

from granary.operators import transfers as tr

SCHEMA = "ingest_pos long, account_label string, transaction_date date, cash_flow_amount decimal(18,2), description string, owner string, reference string, is_internal_candidate boolean, matched_keyword string"


def greedy(rows):
    """The matching as one loop over all rows."""
    used, out = set(), {}
    for n in [r for r in rows if r[3] < 0]:
        best = None
        for p in [r for r in rows if r[3] > 0 and r[0] not in used]:
            days = abs((p[2] - n[2]).days)
            if abs(abs(p[3]) - abs(n[3])) > 0.01 or days > 7:
                continue
            score = 100 - 10 * days + (35 if n[6] and n[6] == p[6] else 0) - (25 if n[1] == p[1] else 0) + (5 if n[5] == p[5] else 0)
            if best is None or score > best[0]:
                best = (score, p[0])
        if best:
            used.add(best[1])
            out[n[0]] = best[1]
    return out


def test_islands_give_the_sequential_matching(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(25))
        cents = rng.choice([10000, 10001, 1000, 1001, 1002, 499, 5000])
        rows.append((i, f"a{rng.randrange(4)}", day, cents / 100 * rng.choice([1, -1]), "transfer", f"o{rng.randrange(2)}", rng.choice(["", "r1"]), True, ""))
    import decimal

    df = spark.createDataFrame([(*r[:3], decimal.Decimal(f"{r[3]:.2f}"), *r[4:]) for r in rows], SCHEMA)
    got = {r["neg_pos"]: r["pos_pos"] for r in tr.first_pass(df).collect()}
    assert got == greedy(rows)


def test_no_rows(spark):
    assert tr.pair_transfers(spark.createDataFrame([], SCHEMA)).count() == 0


def crowd(seed, n, days, accounts=6):
    """Legs of few amounts on many days, so that nearly all compete."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(days))
        sign = 1 if rng.random() < 0.5 else -1
        rows.append((i, f"a{rng.randrange(accounts)}", day, 100.0 * sign, "transfer", f"o{rng.randrange(3)}", rng.choice(["", "", "r1", "r2"]), True, ""))
    return rows


def frame(spark, rows):
    import decimal

    return spark.createDataFrame([(*r[:3], decimal.Decimal(f"{r[3]:.2f}"), *r[4:]) for r in rows], SCHEMA)


def test_a_popular_amount_is_matched_in_blocks_as_in_one_loop(spark):
    for seed, n, days in ((1, 1500, 400), (2, 900, 900), (3, 700, 40)):
        rows = crowd(seed, n, days)
        got = {r["neg_pos"]: r["pos_pos"] for r in tr._pairs(frame(spark, rows), False, most=60).collect()}
        assert got == greedy(rows)


def test_rounds_end_where_rows_come_account_by_account(spark):
    # every account's rows run over all days before the next one's begin
    rows = sorted(crowd(5, 1200, 500), key=lambda r: (r[1], r[2]))
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = {r["neg_pos"]: r["pos_pos"] for r in tr._pairs(frame(spark, rows), False, most=40).collect()}
    assert got == greedy(rows)


def test_what_a_block_settles_holds_whatever_it_does_not_see():
    import pandas as pd

    rows = crowd(7, 4000, 64)
    frame_ = pd.DataFrame([(r[0], (r[2] - datetime.date(2024, 1, 1)).days, abs(r[3]), r[3], r[6], r[1], r[5], False) for r in rows], columns=["ingest_pos", "day", "abs_double", "flow", "reference", "account_label", "owner", "hint"])
    got, want = tr.settle(frame_, False, 0, 63), greedy(rows)
    assert all(want.get(n) == p for n, p in tr.settle(frame_, False))
    # with unseen days on both sides only what cannot change is settled
    assert all(want.get(n) == p for n, p in got)
    assert len(got) > 0.3 * sum(r[3] < 0 for r in rows)


def test_numbers_follow_the_negative_legs(spark):
    pairs = spark.createDataFrame([(n * (1 << 30), n) for n in range(12_000, 0, -7)], "neg_pos long, pos_pos long").repartition(5)
    got = [r["match_id"] for r in tr._numbered(pairs).orderBy("neg_pos").collect()]
    assert got == [f"match-{i:04d}" for i in range(1, len(got) + 1)]
    more = tr._numbered(pairs, pairs).orderBy("neg_pos").first()
    assert more["match_id"] == f"match-{len(got) + 1}"


class Counted(str):
    """A name that counts how often it is compared."""

    seen = 0
    __hash__ = str.__hash__

    def __eq__(self, other):
        Counted.seen += 1
        return str.__eq__(self, other)


def test_work_is_in_proportion_to_the_legs_of_an_amount_and_a_day():
    """Comparisons for a leg stay the same where ten times as many share amount and days (before, they were ten times as many)."""
    rng, each = random.Random(9), []
    for n in (400, 4000):
        legs = [(i, rng.randrange(5), 100.0, 100.0 if i % 2 else -100.0, "", Counted(f"a{rng.randrange(50)}"), Counted("o"), True) for i in range(n)]
        Counted.seen = 0
        assert len(tr._settled([list(x) for x in zip(*legs)], True)) == n // 2
        each.append(Counted.seen / n)
    assert each[1] < 2 * each[0] + 20


def test_keys_give_the_best_of_all_candidates():
    """Both passes with references, owners, hints, near cents and crowded accounts against a look at every candidate; blocks settle nothing else."""

    def every(legs, second):
        taken, out = set(), {}
        for n in (x for x in legs if x[3] < 0):
            if second and n[2] < 5:
                out[n[0]] = None
                continue
            ways = []
            for p in (x for x in legs if x[3] > 0 and x[0] not in taken):
                days, same = abs(p[1] - n[1]), p[5] == n[5]
                if days <= 7 and abs(p[2] - n[2]) <= 0.01 and not (second and (same or not (p[7] or n[7]))):
                    ways.append((-(100 - 10 * days + (35 if n[4] and n[4] == p[4] else 0) - (25 if same else 0) + (5 if n[6] == p[6] else 0)), p[0]))
            out[n[0]] = min(ways)[1] if ways else None
            taken.add(out[n[0]])
        return out

    for seed in range(120):
        rng = random.Random(seed)
        days, accounts, share = rng.choice([1, 6, 60]), rng.choice([1, 2, 9]), rng.choice([0, 0.2, 1])
        legs = []
        for i in range(rng.choice([10, 150])):
            amount = rng.choice([4.99, 5.0, 5.01, 100.0])
            legs.append((i, rng.randrange(days), amount, amount * rng.choice([1, -1]), rng.choice(["", "r1", "r2"]), f"a{rng.randrange(accounts)}", f"o{rng.randrange(3)}", rng.random() < share))
        for second in (False, True):
            want = every(legs, second)
            assert dict(tr._settled([list(x) for x in zip(*legs)], second)) == want
            seen = [x for x in legs if 10 <= x[1] < 50]
            if seen:
                assert all(want[n] == p for n, p in tr._settled([list(x) for x in zip(*seen)], second, 10, 49))


def test_legs_are_matched_once(spark, monkeypatch):
    seen, made = spark.sparkContext.accumulator(0), tr._parts

    def counted(second):
        run = made(second)

        def matched(frames):
            def each():
                for f in frames:
                    seen.add(len(f))
                    yield f

            return run(each())

        return matched

    monkeypatch.setattr(tr, "_parts", counted)
    rows = [(i, f"a{i % 2}", datetime.date(2026, 1, 5), (100 + i // 2) * (1 if i % 2 else -1), "transfer", "o", "", True, "") for i in range(200)]
    assert tr.first_pass(frame(spark, rows)).count() == 100
    assert seen.value == 200
