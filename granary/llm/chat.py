"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its text is trainable (``loss_start``, ``loss_len``: code
points of ``text``).  Turns after the last assistant turn, which no reply
follows, go into one more example without anything trainable, so that the
output holds the whole conversation.

A turn is written as ``<|turn|>ROLE<|text|>TEXT<|end|>``.  Control strings of
this template and of other common ones that stand inside a role or a text get
one more backslash after their first character (``</s>`` becomes ``<\\/s>``);
reading takes it away, and strings that held such a backslash before come back
as they were.

A conversation is one training context, so that an example has to hold all of
it: the turns of a conversation are gathered into one row and have to fit a task, those of the null id, which
count as one conversation, too.  Texts that many conversations share are no keys here and need no care.

Defined results: null roles and texts count as empty; null turns come first;
rows of equal turn come in the order of role, then text; repeated rows are
repeated turns; a null conversation id is a conversation of its own; a
conversation without assistant turns gives the one untrained example; texts of any length are kept whole; an empty
table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TARGET_ROLE = "assistant"
#: What may follow the first character of a control string.
_TAIL = r"(\||/?s>|/?INST\]|</?SYS>>|/SYS>>|SYS>>)"
_ESCAPE, _UNESCAPE = r"([<\[])(\\*)" + _TAIL, r"([<\[])\\(\\*)" + _TAIL


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, r"$1$2$3")


def _segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), role, F.lit(TEXT), text, F.lit(END))


def format_examples(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each example: conv_col, example (from 0), is_last, text, loss_start (from 0), loss_len."""
    blank = F.lit("")
    turns = rows.select(
        F.col(conv_col).alias("cf_conv"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), blank).alias("raw"), F.coalesce(F.col(text_col), blank).alias("said")).alias("cf_turn"),
    )
    # ordered as said, not as escaped
    escaped = lambda t: F.struct(t["raw"].alias("raw"), escape(t["raw"]).alias("role"), escape(t["said"]).alias("text"))
    convs = turns.groupBy("cf_conv").agg(F.transform(F.sort_array(F.collect_list("cf_turn")), escaped).alias("cf_turns"))
    convs = convs.withColumn("cf_ends", F.expr(f"filter(sequence(1, size(cf_turns)), i -> cf_turns[i - 1].raw = '{TARGET_ROLE}' or i = size(cf_turns))"))
    convs = convs.withColumn("cf_segments", F.transform("cf_turns", lambda t: _segment(t["role"], t["text"])))
    each = convs.select("cf_conv", "cf_turns", "cf_segments", F.size("cf_ends").alias("cf_n"), F.posexplode("cf_ends").alias("example", "cf_end"))
    last = F.element_at("cf_turns", F.col("cf_end"))
    trained = last["raw"] == TARGET_ROLE
    text = F.array_join(F.slice("cf_segments", F.lit(1), F.col("cf_end")), "")
    each = each.select("cf_conv", "example", (F.col("example") == F.col("cf_n") - 1).alias("is_last"), text.alias("text"), F.when(trained, F.char_length(last["text"])).otherwise(F.lit(0)).alias("loss_len"))
    start = F.when(F.col("loss_len") > 0, F.char_length("text") - F.lit(len(END)) - F.col("loss_len")).otherwise(F.lit(0))
    return each.select(F.col("cf_conv").alias(conv_col), "example", "is_last", "text", start.cast("long").alias("loss_start"), F.col("loss_len").cast("long").alias("loss_len"))


def parse_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    pieces = F.filter(F.split(text, r"<\|end\|>", -1), lambda x: x != "")
    body = lambda x: F.substring_index(x, TEXT, -1)
    head = lambda x: F.substring_index(F.substring_index(x, TEXT, 1), TURN, -1)
    return F.transform(pieces, lambda x: F.struct(unescape(head(x)).alias("role"), unescape(body(x)).alias("text")))


def read_back(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of each conversation, from the formatted examples alone."""
    loss = unescape(F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_len as int))"))
    each = examples.select(
        conv_col,
        F.struct("example", loss.alias("loss")).alias("cb_loss"),
        F.when(F.col("is_last"), parse_turns(F.col("text"))).alias("cb_turns"),
        F.char_length("text").cast("long").alias("cb_chars"),
    )
    got = each.groupBy(conv_col).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("cb_loss")), lambda x: x["loss"]), "").alias("cb_loss"),
        F.max("cb_turns").alias("cb_turns"),
        F.sum("cb_chars").alias("formatted_chars"),
    )
    whole = F.array_join(F.transform("cb_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        conv_col,
        F.size("cb_turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("cb_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("cb_loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{said}' as text")
    return read_back(format_examples(rows.unionByName(extra)))


ORACLE = r"""
with t0 as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select *, row_number() over w as i, count(*) over (partition by conv_id) as n,
    17 + length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>|/SYS>>|SYS>>)', '\1\\\2\3', 'g'))
       + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>|/SYS>>|SYS>>)', '\1\\\2\3', 'g')) + 6 as seg
  from t0 window w as (partition by conv_id order by turn nulls first, role, text)),
c as (select *, sum(seg) over (partition by conv_id order by i rows between unbounded preceding and current row) as upto from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(upto) filter (role = 'assistant' or i = n))::bigint as formatted_chars
from c group by conv_id
"""
