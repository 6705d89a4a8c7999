"""Pairing the two legs of transfers between accounts: greedy one-to-one matching in row order, exactly.

Two legs can only pair if their absolute amounts are at most a cent apart as binary floats.
About half of all neighbouring cents are further apart than 0.01 as floats, so that even
where every cent occurs amounts fall apart into short runs, the islands, and
matching splits exactly into independent islands.  Legs more than ``PAIR_DAYS`` days apart cannot
pair either, so that an island also splits, exactly, where so many days have none of its legs.
Islands and spans come from the distinct amounts and days only; rows join them by amount and day, so that a popular amount
is spread over its days.

A part of at most ``HOT_LEGS`` legs is matched in one task, in row order.  A larger one is cut into blocks
of ``BLOCK_DAYS`` days, which run at the same time, in rounds.  A block does not see what stands beyond its edges, so that
it settles a negative leg only if nothing unseen can change the outcome: if its best open
positive is one that no smaller unsettled leg may still take.  What a leg that has to wait may take is at most its candidates down to the
first that is certainly free, of which all but that one are in doubt already.  Within a task a leg looks up the first open positives of each day by reference, owner
and account, so that work is in proportion to the legs, however many share an amount and a day.  The next round cuts elsewhere and sees settled legs no more.  The
smallest open leg of a part is settled in two rounds at most, in practice most legs of a block
are; when few enough are left, they are matched in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.classify import has_timing_hint, plain
from granary.functions.fixed import PAIR_CENTS, PAIR_DAYS, SECOND_PASS_LEAST
from granary.shipping import ship
from granary.sources.storage import ranked, written

PAIRS = "neg_pos long, pos_pos long"
#: Distinct cents of one range bucket; a run of adjacent cents that crosses its edge is one island all the same.
SPAN = 1 << 20
#: Legs that one task matches on its own, and the days of a block where there are more: so many that each day is far from the edges in every other round.
HOT_LEGS, BLOCK_DAYS = 400_000, 64
#: The score of two legs on one day, and what a day between them, equal references, one account and one owner make of it.
SAME_DAY, PER_DAY, SAME_REFERENCE, SAME_ACCOUNT, SAME_OWNER = 100, -10, 35, -25, 5


def _linked(low, high):
    """Whether two amounts in cents are close enough as binary floats, which only about half of all neighbours are."""
    return (high - low == 1) & (F.abs(high / F.lit(100.0) - low / F.lit(100.0)) <= PAIR_CENTS)


def islands(amounts: DataFrame) -> DataFrame:
    """cents and island for each distinct value of the column cents; an island is a run of linked amounts."""
    cents = amounts.select("cents").distinct().withColumn("range", F.floor(F.col("cents") / SPAN))
    order = Window.partitionBy("range").orderBy("cents")
    start = F.coalesce(~_linked(F.lag("cents").over(order), F.col("cents")), F.lit(True))
    runs = cents.withColumn("n", F.sum(F.when(start, 1).otherwise(0)).over(order))
    runs = runs.withColumn("island", F.min("cents").over(Window.partitionBy("range", "n")))
    # a run that goes on over the edge of a range takes the name of the run before it, edge by edge
    edge = runs.groupBy("range", "n").agg(F.min("cents").alias("low"), F.max("cents").alias("high"))
    left = edge.where(f"(high + 1) % {SPAN} = 0").where(_linked(F.col("high"), F.col("high") + 1)).select(F.col("low").alias("l_low"), (F.col("high") + 1).alias("l_next"))
    joined = edge.where(f"low % {SPAN} = 0").join(left, F.col("low") == F.col("l_next")).select(F.col("low").alias("island"), F.col("l_low").alias("onto"))
    return runs.join(joined, "island", "left").select("cents", F.coalesce("onto", "island").alias("island"))


#: What a leg is matched by.
LEG = ("ingest_pos", "day", "abs_double", "flow", "reference", "account_label", "owner", "hint")


class _Nearest:
    """Open positives of one key in row order: the first, and the first of another account than the first's; both only move on."""

    __slots__ = ("all", "one", "two")

    def __init__(self) -> None:
        self.all: list[int] = []
        self.one, self.two = 0, 1

    def first(self, gone: bytearray, account: list, other: object = None) -> int | None:
        """The first positive that is not gone, of any account but other."""
        rows, one = self.all, self.one
        while one < len(rows) and gone[rows[one]]:
            one += 1
        self.one = one
        if one == len(rows):
            return None
        if other is None or account[rows[one]] != other:
            return rows[one]
        # what lies between the two is gone or of the first one's account
        two = max(self.two, one + 1)
        while two < len(rows) and (gone[rows[two]] or account[rows[two]] == other):
            two += 1
        self.two = two
        return rows[two] if two < len(rows) else None


class _Held:
    """Doubtful positives of one key, which are never taken here: the first, and the first of another account."""

    __slots__ = ("one", "two")

    def __init__(self) -> None:
        self.one: int | None = None
        self.two: int | None = None

    def add(self, j: int, account: list) -> None:
        if self.one is None:
            self.one = j
        elif j < self.one:
            if account[j] != account[self.one]:
                self.two = self.one
            self.one = j
        elif account[j] != account[self.one] and (self.two is None or j < self.two):
            self.two = j

    def first(self, account: list, other: object = None) -> int | None:
        return self.one if other is None or self.one is None or account[self.one] != other else self.two


def settle(group: pd.DataFrame, second: bool, low: int | None = None, high: int | None = None) -> list[tuple[int, int | None]]:
    """(negative, its positive or None) for the legs of group that are settled, in row order.

    Legs of days before low and after high exist but are not in group; without both, all are, and every negative is settled.
    """
    group = group.sort_values("ingest_pos")
    return _settled([group[n].tolist() for n in LEG], second, low, high)


def _settled(legs: list[list], second: bool, low: int | None = None, high: int | None = None) -> list[tuple[int, int | None]]:
    """settle for columns of LEG that are in order.

    The best positive of a day is the first one of its reference, owner and account, each equal or not.  The first of
    those that are equal at least where the best one is equal is the best one itself, so that a few keys are looked
    up for each day, however many positives it has.
    """
    pos, day, amount, flow, ref, account, owner, hint = legs
    doubted, gone = bytearray(len(pos)), bytearray(len(pos))
    # a leg without a hint needs one that has it
    hinting = second and not all(h or f > 0 for h, f in zip(hint, flow))
    # by amount, day, whether all hint, owner and reference, where None stands for all
    sure: dict[tuple, _Nearest] = defaultdict(_Nearest)
    held: dict[tuple, _Held] = defaultdict(_Held)

    def keys(i: int, c: float, d: int, hints: bool) -> list[tuple]:
        some = [(c, d, hints, None, None), (c, d, hints, owner[i], None)]
        return some + [(c, d, hints, None, ref[i]), (c, d, hints, owner[i], ref[i])] if ref[i] else some

    def own(j: int) -> list[tuple]:
        return keys(j, amount[j], day[j], False) + (keys(j, amount[j], day[j], True) if hinting and hint[j] else [])

    values: set[float] = set()
    for j in range(len(pos)):
        if flow[j] > 0:
            values.add(amount[j])
            # a smaller unseen leg may take it
            if low is not None and day[j] - low < PAIR_DAYS or high is not None and high - day[j] < PAIR_DAYS:
                doubted[j] = 1
                for key in own(j):
                    held[key].add(j, account)
            else:
                for key in own(j):
                    sure[key].all.append(j)

    def better(best: tuple | None, j: int | None, base: int, i: int) -> tuple | None:
        if j is None:
            return best
        score = base + (SAME_REFERENCE if ref[i] and ref[i] == ref[j] else 0) + (SAME_ACCOUNT if account[i] == account[j] else 0) + (SAME_OWNER if owner[i] == owner[j] else 0)
        return (-score, j) if best is None or (-score, j) < best else best

    out: list[tuple[int, int | None]] = []
    for i in range(len(pos)):
        if flow[i] >= 0:
            continue
        if second and amount[i] < SECOND_PASS_LEAST:
            out.append((pos[i], None))
            continue
        cents = round(amount[i] * 100)
        near = [c for c in {amount[i], (cents - 1) / 100, (cents + 1) / 100} if c in values and abs(c - amount[i]) <= PAIR_CENTS]
        hints = second and not hint[i]
        most = SAME_DAY + SAME_OWNER + (SAME_REFERENCE if ref[i] else 0)
        best = doubt = None
        for apart in range(PAIR_DAYS + 1):
            base = SAME_DAY + PER_DAY * apart
            if best is not None and -best[0] > most + PER_DAY * apart:
                # the best certain one: whatever is doubtful and further away is no better
                break
            for d in (day[i] - apart, day[i] + apart) if apart else (day[i],):
                for c in near:
                    for key in keys(i, c, d, hints):
                        if key in sure:
                            got = sure[key]
                            best = better(best, got.first(gone, account, account[i]), base, i)
                            if not second:
                                best = better(best, got.first(gone, account), base, i)
                        if key in held:
                            doubt = better(doubt, held[key].first(account, account[i]), base, i)
                            if not second:
                                doubt = better(doubt, held[key].first(account), base, i)
        # the best that an unseen positive can score
        beyond = [d for d in (day[i] - low + 1 if low is not None else None, high - day[i] + 1 if high is not None else None) if d is not None and d <= PAIR_DAYS]
        unseen = max((most + PER_DAY * d for d in beyond), default=None)
        if best is not None and (doubt is None or best < doubt) and (unseen is None or -best[0] > unseen):
            out.append((pos[i], pos[best[1]]))
            gone[best[1]] = 1
        elif best is None and doubt is None and unseen is None:
            out.append((pos[i], None))
        elif best is not None:
            # it has to wait and takes the best certain one or what is better, which is doubtful already
            gone[best[1]] = doubted[best[1]] = 1
            for key in own(best[1]):
                held[key].add(best[1], account)
    return out


def _matched(group: pd.DataFrame, second: bool, low: int | None = None, high: int | None = None) -> pd.DataFrame:
    return pd.DataFrame(settle(group, second, low, high), columns=["neg_pos", "pos_pos"]).astype("Int64")


def _parts(second: bool):
    """The function for legs sorted by part and row order: parts are cut as they stream by, many in one batch."""

    def matched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = None, [[] for _ in LEG]
        for f in frames:
            out, keys = [], list(zip(f["island"].tolist(), f["span"].tolist()))
            columns = [f[n].tolist() for n in LEG]
            start = 0
            for i in range(len(keys) + 1):
                if i < len(keys) and keys[i] == part:
                    continue
                for kept, new in zip(held, columns):
                    kept += new[start:i]
                start = i
                if i < len(keys):
                    # another part begins here
                    out += _settled(held, second)
                    part, held = keys[i], [[] for _ in LEG]
            yield pd.DataFrame(out, columns=["neg_pos", "pos_pos"]).astype("Int64")
        yield pd.DataFrame(_settled(held, second), columns=["neg_pos", "pos_pos"]).astype("Int64")

    return matched


def _block(second: bool, days: int, shift: int):
    """The function for the legs of one block of a part, where blocks begin so many days early."""

    def matched(group: pd.DataFrame) -> pd.DataFrame:
        low = (int(group["day"].iloc[0]) + shift) // days * days - shift
        high = low + days - 1
        return _matched(group, second, low if low > group["first"].iloc[0] else None, high if high < group["last"].iloc[0] else None)

    return matched


def _in_rounds(open_legs: DataFrame, second: bool, most: int, days: int) -> DataFrame:
    """Pairs of parts that are too large for one task; their legs have columns first and last, the part's days."""
    found, turn = None, 0
    while True:
        waiting = open_legs.where("flow < 0").groupBy("island", "span").count().agg(F.max("count")).first()[0] or 0
        # of the positives only those near an open negative are left; days of an island are few
        near = open_legs.where("flow < 0").select("island", "day").distinct().select("island", F.explode(F.sequence(F.col("day") - PAIR_DAYS, F.col("day") + PAIR_DAYS)).alias("day")).distinct()
        legs_left = open_legs.join(near, ["island", "day"], "left_semi")
        if waiting <= most // 2:
            last = legs_left.groupBy("island", "span").applyInPandas(lambda g: _matched(g, second), PAIRS)
            return last if found is None else found.unionByName(last)
        shift = days // 2 * (turn % 2)

        number = F.floor((F.col("day") + shift) / days)
        got = written(legs_left.groupBy("island", "span", number.alias("block")).applyInPandas(_block(second, days, shift), PAIRS), "settled")
        found = got if found is None else found.unionByName(got)
        settled = got.select(F.explode(F.array("neg_pos", "pos_pos")).alias("leg")).where("leg is not null")
        open_legs = written(legs_left.join(settled, F.col("ingest_pos") == F.col("leg"), "left_anti"), "open")
        turn += 1


def _legs(rows: DataFrame, *more: str) -> DataFrame:
    """What rows are matched by, and more of their columns.  Hints are looked for once in each distinct description."""
    r = rows.where("transaction_date is not null and cash_flow_amount <> 0").withColumn("abs_amount", F.abs("cash_flow_amount"))
    said = r.select(F.col("description").alias("tr_said")).distinct().withColumn("hint", has_timing_hint(plain(F.col("tr_said"))))
    return r.join(written(said, "hints"), F.col("description").eqNullSafe(F.col("tr_said"))).select(
        "ingest_pos", F.unix_date("transaction_date").alias("day"), F.col("abs_amount").cast("double").alias("abs_double"), F.col("cash_flow_amount").cast("double").alias("flow"),
        F.coalesce("reference", F.lit("")).alias("reference"), F.coalesce("account_label", F.lit("")).alias("account_label"), F.coalesce("owner", F.lit("")).alias("owner"),
        "hint", (F.col("abs_amount") * 100).cast("long").alias("cents"), *more,
    )


def _pairs(rows: DataFrame, second: bool, most: int | None = None, days: int | None = None) -> DataFrame:
    """Pairs among rows, or among what _legs made of them."""
    ship(rows.sparkSession)
    most, days = most or HOT_LEGS, days or BLOCK_DAYS
    if days < 8 * PAIR_DAYS:
        raise ValueError("blocks have to be eight times as long as pairs are apart")
    r = rows if "cents" in rows.columns else _legs(rows)
    # amounts and days: how many legs there are, and of which signs
    keys = r.groupBy("cents", "day").agg(F.count("*").alias("n"), F.min("flow").alias("low"), F.max("flow").alias("high"))
    keys = keys.join(islands(keys), "cents")
    # the days of an island, cut at gaps
    by_day = Window.partitionBy("island").orderBy("day")
    gap = F.coalesce(F.col("day") - F.lag("day").over(by_day) > PAIR_DAYS, F.lit(True)).cast("int")
    spans = keys.groupBy("island", "day").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).withColumn("gap", gap).withColumn("span", F.sum("gap").over(by_day))
    part = Window.partitionBy("island", "span")
    spans = spans.select("island", "day", "span", F.sum("n").over(part).alias("legs"), F.min("day").over(part).alias("first"), F.max("day").over(part).alias("last"), F.min("low").over(part).alias("low"), F.max("high").over(part).alias("high"))
    # parts with one sign only have nothing to pair
    keys = written(keys.select("cents", "day", "island").join(spans.where("low < 0 and high > 0").drop("low", "high"), ["island", "day"]), "islands")
    placed = r.join(keys, ["cents", "day"]).drop("cents")
    sorted_ = placed.where(F.col("legs") <= most).select("island", "span", *LEG).repartition("island", "span").sortWithinPartitions("island", "span", "ingest_pos")
    small = sorted_.mapInPandas(_parts(second), PAIRS)
    if not keys.where(F.col("legs") > most).isEmpty():
        small = small.unionByName(_in_rounds(written(placed.where(F.col("legs") > most), "open"), second, most, days))
    return small.where("pos_pos is not null")


def _numbered(pairs: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """match_id in order of discovery: that of the negative legs."""
    # written first: a sort by range reads its input twice, and the matching is behind it
    got = ranked(written(pairs, "found"), "neg_pos", "number")
    before = F.lit(1)
    if after is not None:
        before = F.lit(after.count() + 1)
    number = F.col("number") + before
    label = F.concat(F.lit("match-"), F.lpad(number.cast("string"), 4, "0"))
    label = F.when(number > 9999, F.concat(F.lit("match-"), number.cast("string"))).otherwise(label)
    return got.select("neg_pos", "pos_pos", label.alias("match_id"))


def legs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("neg_pos", "pos_pos")).alias("leg_pos"), F.col("match_id").alias("leg_match"))


def first_pass(rows: DataFrame) -> DataFrame:
    """Pairs among the candidates by wording."""
    return _numbered(_pairs(rows.where("is_internal_candidate"), False))


def second_pass(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Pairs among all other rows of at least 5.00, between different accounts, where a leg hints at a transfer."""
    rest = (rows if "cents" in rows.columns else _legs(rows)).join(legs(taken).hint("shuffle_hash"), F.col("ingest_pos") == F.col("leg_pos"), "left_anti").drop("is_internal_candidate")
    return _numbered(_pairs(written(rest, "rest"), True), taken)


def pair_transfers(rows: DataFrame) -> DataFrame:
    """Sets match_id, internal_match_status, is_internal_candidate and matched_keyword from both passes."""
    # both passes are read several times
    all_legs = written(_legs(rows, "is_internal_candidate"), "legs")
    one = written(first_pass(all_legs), "pairs")
    two = written(second_pass(all_legs, one), "pairs")
    found = legs(one).withColumn("late", F.lit(False)).unionByName(legs(two).withColumn("late", F.lit(True)))
    # whole rows are dealt out but not sorted
    got = rows.join(found.hint("shuffle_hash"), F.col("ingest_pos") == F.col("leg_pos"), "left")
    hit, late = F.col("leg_pos").isNotNull(), F.coalesce("late", F.lit(False))
    return got.withColumns({
        "match_id": F.coalesce("leg_match", F.lit("")),
        "internal_match_status": F.when(hit, "Matched").when(F.col("is_internal_candidate"), "Unmatched").otherwise("None"),
        "is_internal_candidate": F.col("is_internal_candidate") | late,
        "matched_keyword": F.when(late & (F.trim(F.coalesce("matched_keyword", F.lit(""))) == ""), "amount+timing").otherwise(F.col("matched_keyword")),
    }).drop("leg_pos", "leg_match", "late")
