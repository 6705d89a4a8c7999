"""Conversation structure repair by error-correcting Earley parsing.

A conversation should read ``(s?(ua)+)?`` in the first letters of its roles: an
optional system turn, then pairs of a user and an assistant turn.  Every row is
kept, given another role, or deleted, and empty turns are inserted, at the
least total cost; of equally cheap repairs the one whose audit (K, R, D, I in
order) is least in ASCII order is taken.

The grammar is weighted: besides its own terminals it has error productions for
deleted, rerolled and inserted turns.  It is left-linear, so that every chart
item starts at row 0 and a set of the chart holds at most one item for each dotted rule:
time and memory are linear in the rows.  An item keeps the least (cost, audit).
Audits are compared by rank: those that end at the same row with an edit of that row
are free of prefixes of each other, so that their order never changes as
they grow, and an item holds a number and not a string.

How it runs: one shuffle puts a conversation's rows in order and marks their faults; one letter
a row goes to the parser; the audit then travels ahead of the rows through a second shuffle, whose tasks stream
them and hash the repaired text as it passes.  Neither step holds the texts of a
conversation in memory.  SHA-256 is a chain, so that the rows of
one conversation do pass through one task, as a stream.

Defined results: null conversation ids are one conversation; null roles and texts count as one space
(for the damage, so do null ids and turns); null turns come first and make no gaps; rows of equal turn
come in the order of role, then text; of repeated rows all but the first are duplicates; a row of
another role than s, u or a (by its first letter) cannot be kept; texts of any length are kept whole;
a conversation without rows after damage gives zeros, an empty audit and the
hash of nothing; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import materialise, scratch, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
BLANK_SET = r"\x20\x09-\x0D"

#: Lower-case symbols are terminals, "." is the end; GOAL must come first.
GRAMMAR = (
    ("GOAL", ("TALK", ".")),
    ("TALK", ()),
    ("TALK", ("TURNS",)),
    ("TURNS", ("ASK", "a")),
    ("ASK", ("u",)),
    ("ASK", ("LEAD", "u")),
    ("ASK", ("TURNS", "u")),
    ("LEAD", ("s",)),
)
#: Rules that wait at row 0 for a symbol: by it.
WAITING = {x: [r for r, (_, body) in enumerate(GRAMMAR) if body[:1] == (x,)] for x in {name for name, _ in GRAMMAR}}

Item = tuple[int, int]


def _close(kernel: list[tuple[int, int, str, Item, Item | None]]) -> dict[Item, tuple[int, int, str, Item | None]]:
    """All items of a chart set with their least (cost, rank, inserts since the row) and the kernel item they come from."""
    heap, chart = [], {}
    for entry in kernel:
        heappush(heap, entry)
    while heap:
        cost, rank, inserts, (rule, dot), origin = heappop(heap)
        if (rule, dot) in chart:
            continue
        chart[rule, dot] = cost, rank, inserts, origin
        name, body = GRAMMAR[rule]
        if dot == len(body):
            for other in WAITING[name]:
                heappush(heap, (cost, rank, inserts, (other, 1), origin))
        elif body[dot] in NAMES:
            heappush(heap, (cost + INSERT, rank, inserts + "I", (rule, dot + 1), origin))
    return chart


def _scan(chart: dict, code: str) -> dict[Item, tuple[int, int, str, Item]]:
    """The kernel after one row: each item's least (cost, rank, edits since the last row) and its kernel item before."""
    after: dict[Item, tuple[int, int, str, Item]] = {}
    letter, extra = code.lower(), TRUNCATED if code.isupper() else 0
    for (rule, dot), (cost, rank, inserts, origin) in chart.items():
        body = GRAMMAR[rule][1]
        if dot == len(body) or body[dot].isupper():
            continue
        moves = [(cost + DELETE, rank, inserts + "D", dot)]
        if letter != "x" and body[dot] == letter:
            moves.append((cost + extra, rank, inserts + "K", dot + 1))
        elif letter != "x" and body[dot] in NAMES:
            moves.append((cost + REROLE + extra, rank, inserts + "R", dot + 1))
        for c, r, edits, to in moves:
            item = (rule, to)
            if item not in after or (c, r, edits) < after[item][:3]:
                after[item] = c, r, edits, origin
    return after


def parse(codes: str) -> tuple[int, str]:
    """(cost, audit) of rows given as one letter each: the first letter of the role (o: another one), in capitals if truncated; x has to go."""
    start = [(0, 0, "", (rule, 0), (rule, 0)) for rule in range(len(GRAMMAR))]
    chart, steps = _close(start), []
    for code in codes:
        after = _scan(chart, code)
        order = {key: i for i, key in enumerate(sorted({(rank, edits) for _, rank, edits, _ in after.values()}))}
        steps.append({item: (edits, origin) for item, (_, _, edits, origin) in after.items()})
        chart = _close([(cost, order[rank, edits], "", item, item) for item, (cost, rank, edits, _) in after.items()])
    cost, _, inserts, item = chart[0, 1]
    parts = [inserts]
    for step in reversed(steps):
        edits, item = step[item]
        parts.append(edits)
    return cost, "".join(reversed(parts))


_parse_short = lru_cache(1 << 16)(parse)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [_parse_short(c) if len(c) <= 64 else parse(c) for c in b.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=[*b.schema.names, "cost", "audit"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a header (place 0, the audit as text) and the rows of each conversation; gives the hash of its repaired rows."""
    conv, audit, at, made, odd, digest = None, None, 0, 0, 0, hashlib.sha256()

    def put(role: str | None, text: str) -> None:
        nonlocal made
        role = role if role is not None else NAMES["ua"[(made - odd) % 2]]
        digest.update(f"{chr(10) if made else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        made += 1

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put(None, "")
            at += 1

    def result(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], kind), pa.array([x[1] for x in rows], pa.string())], names=["conv", "sha"])

    kind = pa.null()
    for b in batches:
        done, kind = [], b.schema.field("conv").type
        for c, place, role, text in zip(*(b.column(x).to_pylist() for x in ("conv", "place", "role", "text"))):
            if place == 0:
                if audit is not None:
                    inserts()
                    done.append((conv, digest.hexdigest()))
                conv, audit, at, made, digest = c, text, 0, 0, hashlib.sha256()
                # an odd number of turns starts with a system turn
                odd = (len(text) - text.count("D")) % 2
                continue
            inserts()
            if audit[at] != "D":
                put(role if audit[at] == "K" else None, text)
            at += 1
        if done:
            yield result(done)
    if audit is not None:
        inserts()
        yield result([(conv, digest.hexdigest())])


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text and dropped of each row after the fault that the hash of its conversation and turn gives it; dropped rows stay, marked."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    hurt = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fault == 0).alias("dropped"), F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return hurt.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def mark_faults(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, dropped) with their place in the conversation (from 1), first fault, initial, code and what stands before them."""
    # both orders are found from one shuffle by conversation
    same = Window.partitionBy("conv", "dropped", "role", "text").orderBy("place")
    order = Window.partitionBy("conv").orderBy("dropped", "turn", "role", "text")
    last = F.regexp_extract("text", rf"([^{BLANK_SET}])[{BLANK_SET}]*\z", 1)
    fault: Column = F.when(last == "", "blank").when(F.col("again") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    got = rows.repartition("conv").withColumn("initial", F.substring("role", 1, 1))
    got = got.withColumns({"place": F.row_number().over(order).cast("long"), "before": F.lag("initial").over(order), "turn_before": F.lag("turn").over(order)})
    got = got.withColumn("again", F.row_number().over(same)).withColumn("fault", fault)
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return got.withColumn("code", code).drop("again")


def repair(rows: DataFrame) -> DataFrame:
    """For each conv of rows (conv, turn, role, text, dropped): gaps, faults, illegal pairs, and the cheapest repair with its hash."""
    marked = materialise(mark_faults(rows), "repair-rows")
    live = ~F.col("dropped")
    count = lambda x: F.coalesce(F.sum(F.when(live & x, 1)), F.lit(0)).cast("long")
    turns = count(F.col("turn").isNotNull() & ~F.coalesce(F.col("turn") == F.col("turn_before"), F.lit(False)))
    turn = F.when(live, F.col("turn"))
    counted = marked.groupBy("conv").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - turns, F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")],
        count(F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")).alias("illegal"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(live, F.struct("place", "code")))), lambda x: x["code"]), "").alias("codes"),
    )
    kind = rows.schema["conv"].dataType
    parsed = counted.mapInArrow(_parsed, counted.select("*").schema.add("cost", "long").add("audit", "string")).drop("codes")
    parsed = materialise(parsed, "repair-audits")
    header = parsed.select("conv", F.lit(0).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = header.unionByName(marked.where(live).select("conv", "place", "role", "text")).repartition("conv").sortWithinPartitions("conv", "place")
    digests = stream.mapInArrow(_hashed, f"conv {kind.simpleString()}, sha string")
    return parsed.join(digests, parsed["conv"].eqNullSafe(digests["conv"])).drop(digests["conv"]).withColumnRenamed("sha", "repaired_sha256")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    with scratch(spark):
        got = materialise(repair(rows).withColumnRenamed("conv", "conv_id"), "op11", keep=1)
    return got


ORACLE = r"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint) as bytes from conversations),
hit as (select * exclude (bytes, t), xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as f from keyed, crc),
hurt as (select conv_id, turn, case when f = 4 then 'user' else role end as role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from hit, (values (0), (1)) v(copy) where f <> 0 and (copy = 0 or f = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as place, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) as last, role[1] as initial from hurt),
again as (select *, row_number() over (partition by conv_id, role, text order by place) as again from placed),
marked as (select *, case when last = '' then 'blank' when again > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' else '' end as fault, lag(initial) over (partition by conv_id order by place) as before from again),
counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n from marked group by conv_id),
-- states: e nothing yet, s a system turn, u and a the last turn; each holds the least (cost, audit), a cost of a million is out of reach
steps as (
  select conv_id, 0 as i, {c: 0, a: ''} as e, {c: 1000000, a: ''} as s, {c: 3, a: 'I'} as u, {c: 6, a: 'II'} as a from counted
  union all
  select conv_id, i, e, s, u, least(a, {c: u.c + 3, a: u.a || 'I'}) from (
    select w.conv_id, w.i, w.e, w.s, least(w.u, {c: least(w.e, w.s, w.a).c + 3, a: least(w.e, w.s, w.a).a || 'I'}) as u, w.a from (
      select k.conv_id, k.i + 1 as i, {c: k.e.c + 4, a: k.e.a || 'D'} as e,
        least({c: k.s.c + 4, a: k.s.a || 'D'}, {c: case when m.keep and m.initial = 's' then k.e.c + m.more else 1000000 end, a: k.e.a || 'K'}) as s,
        least({c: k.u.c + 4, a: k.u.a || 'D'}, case when m.keep then {c: least(k.e, k.s, k.a).c + m.more + case when m.initial = 'u' then 0 else 3 end, a: least(k.e, k.s, k.a).a || case when m.initial = 'u' then 'K' else 'R' end} else {c: 1000000, a: ''} end) as u,
        least({c: k.a.c + 4, a: k.a.a || 'D'}, case when m.keep then {c: k.u.c + m.more + case when m.initial = 'a' then 0 else 3 end, a: k.u.a || case when m.initial = 'a' then 'K' else 'R' end} else {c: 1000000, a: ''} end) as a
      from steps k join (select conv_id, place, initial, fault not in ('blank', 'duplicate') as keep, case when fault = 'truncated' then 3 else 0 end as more from marked) m on m.conv_id is not distinct from k.conv_id and m.place = k.i + 1) w)),
best as (select k.conv_id, least(k.e, k.a) as b from steps k join counted c on c.conv_id is not distinct from k.conv_id and c.n = k.i),
edits as (select conv_id, b.a as audit, o, b.a[o] as op, length(replace(replace(b.a[:o], 'I', ''), ' ', '')) as place, length(replace(b.a[:o], 'D', '')) as made, length(replace(b.a, 'D', '')) % 2 as odd from best, range(1, 1 + length(b.a)) r(o)),
turns as (select e.conv_id, e.o, case e.op when 'K' then m.role else case when (e.made - e.odd) % 2 = 1 then 'user' else 'assistant' end end || ':' || case e.op when 'I' then '' else m.text end as t
  from edits e left join marked m on e.op <> 'I' and m.conv_id is not distinct from e.conv_id and m.place = e.place where e.op <> 'D'),
whole as (select conv_id, string_agg(t, chr(10) order by o) as t from turns group by conv_id),
ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit, sha256(coalesce(whole.t, '')) as repaired_sha256
from ids left join counted on counted.conv_id is not distinct from ids.conv_id left join best on best.conv_id is not distinct from ids.conv_id left join whole on whole.conv_id is not distinct from ids.conv_id
"""
