"""Conversation repair: the parser against a search of all edits, the operator against a plain version and SQL."""

import hashlib
import itertools
import zlib

import pytest
from granary.llm import repair
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, place string, codes int"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest(codes):
    """(cost, audit) over all sequences of edits, by the turns made so far."""
    best, inf = {"": (0, "")}, (10**9, "")

    def insert(states):
        for _ in range(3):
            for made, (cost, audit) in list(states.items()):
                new = "a" if made == "u" else "u"
                if (cost + 3, audit + "I") < states.get(new, inf):
                    states[new] = cost + 3, audit + "I"
        return states

    best = insert(best)
    for code in codes:
        after = {}
        for made, (cost, audit) in best.items():
            ways = [(made, cost + 4, "D")]
            if code != "x":
                more, own = 3 * code.isupper(), code.lower()
                for to in {"": "su", "s": "u", "a": "u", "u": "a"}[made]:
                    if to == own:
                        ways.append((to, cost + more, "K"))
                    elif to != "s":
                        ways.append((to, cost + more + 3, "R"))
            for to, c, e in ways:
                after[to] = min(after.get(to, inf), (c, audit + e))
        best = insert(after)
    return min(best.get("", inf), best.get("a", inf))


def plain(rows):
    """The whole operator on (conv_id, turn, role, text), a loop a conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        hurt = []
        for _, turn, role, text in (r[:4] for r in rows if r[0] == conv):
            role, text = (" " if role is None else role), (" " if text is None else text)
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if fault == 0:
                continue
            text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
            hurt += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes, counts, initials = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in hurt:
            body, own = text.strip(WHITE), role[:1] if role[:1] and role[:1] in "sua" else "o"
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes += "x" if fault in ("blank", "duplicate") else own.upper() if fault else own
            initials.append(role[:1])
        cost, audit = cheapest(codes)
        made, at, odd = [], 0, len(audit.replace("D", "")) % 2
        for edit in audit:
            if edit in "RI":
                role = "ua"[(len(made) - odd) % 2]
                role = {"u": "user", "a": "assistant"}[role]
            if edit == "I":
                made.append(f"{role}:")
                continue
            if edit != "D":
                made.append(f"{hurt[at][1] if edit == 'K' else role}:{hurt[at][2]}")
            at += 1
        turns = [t for t, _, _ in hurt if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r[0]: tuple(r[1:]) for r in repair.repair(repair.damage(df)).collect()}


def test_parser_finds_the_cheapest_and_least_edits():
    for n in range(5):
        for codes in itertools.product("suaoSUAOx", repeat=n):
            assert repair.parse("".join(codes)) == cheapest(codes)


def test_long_conversations_take_linear_time():
    codes = "sua" + "uax" * 7_000 + "aoU"
    cost, audit = repair.parse(codes)
    assert cost == 4 * 7_000 + cheapest("suauaaoU")[0]
    assert sum(audit.count(x) for x in "KRD") == len(codes)


def test_rows_of_all_kinds_agree_with_the_plain_version(spark):
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(8):
            h = zlib.crc32(f"{conv}/{turn}".encode())
            role = [None, "", "system", "user", "user", "assistant", "assistant", "tool", "usher"][h % 9]
            text = [None, "", " \t\n", "Yes.", "Yes.", "no", "So ", "Wait?\x0b", "é!"][h // 9 % 9]
            rows.append((conv, None if h % 17 == 0 else turn - h % 2, role, text, "own", 7))
    rows += [rows[5], rows[5], rows[9]]
    rows.append((77, 0, "user", "word " * 400_000 + ".", "own", 7))
    assert run(spark, rows) == plain(rows)


def test_a_long_conversation_and_one_of_which_nothing_is_left(spark):
    gone = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(1, t, "user" if t % 3 else "assistant", f"turn {t}.", "", 0) for t in range(3_000)] + [(gone, 0, "user", "x.", "", 0)]
    got = run(spark, rows)
    assert got == plain(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_an_empty_table(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_the_query_agrees_with_its_sql(spark, sf):
    import duckdb
    from tests.conftest import rows_of

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got, df = con.execute(repair.ORACLE), repair.op11_repair(spark, sf)
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in got.description], got.fetchall())
    assert df.where(F.col("cost") > 0).count() > 10
