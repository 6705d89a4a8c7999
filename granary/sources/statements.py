"""Statement files: choosing them, what their names say, and the rows in their texts.

Files are chosen and dated with column functions.  The texts themselves are read by small line
machines, one file a row of mapInArrow; a file that cannot be read gives one row with ``error``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from datetime import date, datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.fixed import NOT_NAMES
from granary.functions.text import url_decode
from granary.sources.bank import MONTHS, day_of, fill_days, parse_bank, split_reference
from granary.shipping import ship
from granary.sources.storage import ranked

# --- fixed values: how files are named and statements worded ---
STEM = r"(?i)^(Chequing|Visa|MasterCard|Credit Line) Statement-(\d{4}) (\d{4})-(\d{2})-(\d{2})"
LOGICAL = r"(?i)^(.+Statement-\d{4})\s+(\d{4}-\d{2}-\d{2})(?:-\d+)*$"
PERIOD_CARD = r"STATEMENT FROM ([A-Z]{3}) (\d{1,2})(?:, (\d{4}))? TO ([A-Z]{3}) (\d{1,2}), (\d{4})"
PERIOD_BANK = r"From ([A-Z][a-z]+) (\d{1,2}), (\d{4}) to ([A-Z][a-z]+) (\d{1,2}), (\d{4})"
MONEY = re.compile(r"\(?-?\$?[\d,]+\.\d{2}\)?")
CARD_TXN = re.compile(r"^([A-Z]{3}) (\d{1,2}) ([A-Z]{3}) (\d{1,2}) (.+)$")
CARD_HEAD = re.compile(r"^(.*?(\d{4})) - (PRIMARY|CO-APPLICANT|AUTHORIZED USER)", re.I)
BANK_DAY = re.compile(r"^(\d{1,2}) ([A-Z][a-z]{2})\b\s*(.*)$")
BOILERPLATE = re.compile(r"^\s*(\d+ of \d+|page \d+|details of your account activity.*|date description .*|closing balance.*|opening balance.*)\s*$", re.I)
#: What a credit line's row says when it pays the line back; all others draw on it.
PAYS_BACK = ("interest payment", "www pmt", " pmt ")
LINE_MONEY = re.compile(r"\(([\d,]+\.\d{2})\)|(-?)\s*(?<![\d,])([\d,]+\.\d{2})")
LINE_TAIL = re.compile(r"(?:\s*(?:\([\d,]+\.\d{2}\)|-?\s*[\d,]+\.\d{2}))+\s*$")
TAG = re.compile(r"<.*?>")
CELL = re.compile(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>")
ROLE = re.compile(r"\b(PRIMARY|CO-APPLICANT|JOINT|AUTHORIZED USER)\b", re.I)
#: How many lines of a text name its holders, and how many before a table or card heading belong to it.
HEAD_LINES, NEAR_LINES = 120, 20
TOLERANCE = 0.02
RAW = (
    "statement_id string, source_file string, source_kind string, statement_type string, account_last4 string, account_label string, owner string, role string, household string, transaction_date date, posting_date date, "
    "description string, reference string, amount double, balance double, statement_start date, statement_end date, notes string, line_pos long, error string"
)


def logical_stem(stem: Column) -> Column:
    """A statement's stem without copy suffixes (-1, -2-1), one space before its date; other stems as they are."""
    return F.regexp_replace(F.trim(stem), LOGICAL, "$1 $2")


def unique_statements(files: DataFrame, folders: bool = True) -> DataFrame:
    """Of files (stem, ext, drop: whether in the drop folder) one for each statement: drop folder, PDF, fewest suffixes, stem.

    Without folders, as the audit does it, where a file lies does not count.  What ties in all of these goes by the path, if there is one.
    """
    decoded = files.withColumn("stem", url_decode(F.col("stem"))).withColumn("logical", logical_stem(F.col("stem")))
    suffixes = F.regexp_count(F.regexp_extract("stem", r"\d{4}-\d{2}-\d{2}((?:-\d+)*)$", 1), F.lit("-"))
    order = [F.when(F.lower("ext") == "pdf", 0).otherwise(1), suffixes, F.col("stem"), *[F.col(c) for c in files.columns if c == "path"]]
    w = Window.partitionBy("logical").orderBy(*([F.col("drop").desc()] if folders else []), *order)
    # dealt out before the window: its limit would sort all copies of a file's split in one task first
    return decoded.repartition("logical").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "logical")


def statement_meta(stem: Column) -> dict[str, Column]:
    """kind, last4, date, month and account key, from the name alone; null where it is none of ours."""
    # matched once: behind the kind stand " Statement-", four digits, a space and a day
    found = F.regexp_extract(stem, STEM, 0)
    known, day = found != "", F.right(found, F.lit(10))
    kind, last4 = F.regexp_replace(F.lower(F.left(found, F.length(found) - 26)), " ", "_"), F.substring(found, -15, 4)
    return {
        "account_kind": F.when(known, kind).otherwise("unknown"), "account_last4": F.when(known, last4), "statement_date": F.when(known, day.try_cast("date")),
        "statement_month": F.when(known, F.left(day, F.lit(7))), "account_key": F.when(known, F.concat_ws("-", kind, last4)).otherwise("unknown"),
    }


def statement_period(text: Column) -> tuple[Column, Column]:
    """First and last day by the statement's heading; a start after the end belongs to the year before."""
    # the whole text is looked through once for each heading, whose parts come from the heading
    part = lambda pattern, i: F.regexp_extract(F.regexp_extract(text, pattern, 0), pattern, i)

    def day(pattern: str, month: int, number: int, year: Column) -> Column:
        name = F.substring(F.initcap(F.lower(part(pattern, month))), 1, 3)
        # without a heading there is nothing to read: a failed parse costs more than all scans
        return F.when(F.regexp_extract(text, pattern, 0) != "", F.try_to_date(F.concat_ws(" ", name, part(pattern, number), year), "MMM d yyyy"))

    end = F.coalesce(day(PERIOD_CARD, 4, 5, part(PERIOD_CARD, 6)), day(PERIOD_BANK, 4, 5, part(PERIOD_BANK, 6)))
    own = part(PERIOD_CARD, 3)
    card = day(PERIOD_CARD, 1, 2, F.when(own != "", own).otherwise(part(PERIOD_CARD, 6)))
    start = F.coalesce(card, day(PERIOD_BANK, 1, 2, part(PERIOD_BANK, 3)))
    return F.when(start > end, F.add_months(start, -12)).otherwise(start), end


def money(token: str) -> float:
    value = float(re.sub(r"[^\d.]", "", token))
    return -value if token.startswith(("-", "(")) or "-" in token[:2] else value


def names_in(lines: list[str]) -> list[str]:
    """The probable names among lines: two to four words of capitals, each of letters only and more than one."""
    found = []
    for line in lines:
        line = line.lstrip("# ")
        parts = (html.unescape(TAG.sub("", line)) if "<" in line or "&" in line else line).split()
        line = " ".join(parts)
        if 2 <= len(parts) <= 4 and line == line.upper() and line not in NOT_NAMES and all(p.isalpha() and len(p) > 1 for p in parts):
            found.append(line.title())
    return found


def holders(text: str) -> list[str]:
    """The names in the first lines of a statement, each once, in order."""
    return list(dict.fromkeys(names_in(text.splitlines()[:HEAD_LINES])))


def context(lines: list[str]) -> dict[str, str]:
    """Owner, role and card number that the last lines before a table or heading tell; what they do not tell is left out."""
    near = lines[-NEAR_LINES:]
    found = {"owner": n[-1] for n in [names_in(near)] if n}
    text = "\n".join(near)
    if role := ROLE.search(text):
        found["role"] = role[1].title()
    if card := re.search(rf"(\d{{4}})\s*-\s*(?:{ROLE.pattern})", text, re.I):
        found["account_last4"] = card[1]
    return found


def parse_card(text: str, start: date | None, end: date | None) -> list[dict]:
    rows, open_row, held = [], None, {"account_last4": ""}
    lines = text.splitlines()
    for number, line in enumerate(lines):
        line = line.strip()
        if m := CARD_HEAD.match(line):
            held, open_row = context(lines[: number + 1]) | {"account_last4": m[2]}, None
        elif m := CARD_TXN.match(line):
            if m[1].lower() in MONTHS and m[3].lower() in MONTHS:
                days = [day_of(m[i], m[i + 1], start, end) for i in (1, 3)]
                open_row = {"transaction_date": days[0], "posting_date": days[1], "description": m[5], "reference": "", **held, "line_pos": number}
                if (t := MONEY.search(m[5])) and t.end() == len(m[5]):
                    rows.append(open_row | {"description": m[5][: t.start()].strip(), "amount": money(t[0])})
                    open_row = None
        elif open_row is not None:
            if re.fullmatch(r"\d{12,}", line):
                open_row["reference"] = line
            elif MONEY.fullmatch(line):
                rows.append(open_row | {"amount": money(line)})
                open_row = None
            elif line:
                open_row["description"] += " " + line
    return rows


def credit_line_amount(body: str) -> float | None:
    """What a row moves: amounts in parentheses are credits, a negative last one is the balance owing, an amount said twice counts once."""
    values = [float((m[1] or m[3]).replace(",", "")) * (-1 if m[2] == "-" else 1) for m in LINE_MONEY.finditer(body)]
    text = body.lower()
    owing = len(values) > 1 and values[-1] < 0
    if owing:
        values.pop()
    if len(values) == 2 and abs(values[0] - values[1]) < TOLERANCE and ("principal" in text or not owing and min(values) >= 0):
        values.pop()
    net = round(sum(values), 2)
    if not net:
        return None
    paid = any(w in text for w in PAYS_BACK) or "principal" in text and "tfr" not in text
    return abs(net) if paid else -abs(net)


def parse_credit_line(text: str, start: date | None, end: date | None) -> list[dict]:
    """Rows are chunks of lines from one day to the next; one without a day goes on from the page before, as in bank statements."""
    chunks, inside, fresh = [], False, False
    for number, line in enumerate(text.splitlines()):
        line = line.strip()
        if re.search(r"date\s+description", line, re.I):
            inside, fresh = True, True
            continue
        if re.match(r"closing balance", line, re.I):
            inside = False
        if not inside or not line or BOILERPLATE.match(line):
            continue
        if (m := BANK_DAY.match(line)) and m[2].lower() in MONTHS:
            chunks.append([day_of(m[2], m[1], start, end), number, [m[3]]])
        elif fresh or not chunks:
            chunks.append([None, number, [line]])
        else:
            chunks[-1][2].append(line)
        fresh = False
    rows = []
    for (_, number, lines), day in zip(chunks, fill_days([c[0] for c in chunks], end)):
        body = " ".join(x for x in lines if x)
        if (amount := credit_line_amount(f"{body} ")) is not None:
            description, reference = split_reference(LINE_TAIL.sub("", body).strip() or body)
            rows.append({"transaction_date": day, "posting_date": None, "description": description, "reference": reference, "account_last4": "", "line_pos": number, "amount": amount, "balance": owing(body)})
    return rows


def owing(body: str) -> float | None:
    """The balance that a credit line's row ends with, a negative amount."""
    found = list(LINE_MONEY.finditer(f"{body} "))
    return -float(found[-1][3].replace(",", "")) if found and found[-1][2] == "-" else None


def _cells(row: str) -> list[str]:
    return [" ".join(html.unescape(TAG.sub("", c) if "<" in c else c).split()) for c in CELL.findall(row)]


def _loose_date(text: str, start: date | None, end: date | None) -> tuple[bool, date | None]:
    """Whether a cell holds a date, and the day: null where it names no year and the statement no period."""
    form, got = _day_said(text.strip().title())
    if got is None:
        return False, None
    return True, got if "%Y" in form else day_of(got.strftime("%b"), str(got.day), start, end)


@lru_cache(4096)
def _day_said(said: str) -> tuple[str, date | None]:
    """The first form that reads a day, and the day, in a leap year where the form has none.  Days repeat from row to row."""
    for form in ("%b %d", "%d %b", "%B %d", "%Y-%m-%d", "%b %d, %Y"):
        try:
            got = datetime.strptime(said, form) if "%Y" in form else datetime.strptime(f"{said} 2024", f"{form} %Y")
        except ValueError:
            continue
        return form, got.date()
    return "", None


def parse_tables(text: str, start: date | None, end: date | None) -> list[dict]:
    """HTML tables in Markdown: their header says whether they are a card's or a bank account's."""
    rows, done = [], 0
    for number, found in enumerate(re.finditer(r"(?is)<table.*?>(.*?)</table>", text)):
        body, held, done = found[1], context(text[done : found.start()].splitlines()), found.end()
        table = [_cells(r) for r in re.findall(r"(?is)<tr[^>]*>(.*?)</tr>", body)]
        if not table:
            continue
        head = [c.upper() for c in table[0]]
        at = {k: next((i for i, c in enumerate(head) if k in c), None) for k in ("POSTING", "DESCRIPTION", "AMOUNT", "DEBIT", "WITHDRAWAL", "CREDIT", "DEPOSIT", "BALANCE")}
        debit, credit = at["DEBIT"] if at["DEBIT"] is not None else at["WITHDRAWAL"], at["CREDIT"] if at["CREDIT"] is not None else at["DEPOSIT"]
        cell = lambda r, i: r[i] if i is not None and i < len(r) else ""
        number_in = lambda t: money(m[0]) if (m := MONEY.search(t)) else None
        last = None
        for k, r in enumerate(table[1:]):
            dated, day = _loose_date(cell(r, 0), start, end)
            said, reference = split_reference(cell(r, at["DESCRIPTION"]))
            if not dated:
                if last is not None and not cell(r, 0) and said:
                    last["reference" if re.fullmatch(r"\d{10,}", said) else "notes"] = said
                continue
            if debit is not None or credit is not None:
                d, c = number_in(cell(r, debit)), number_in(cell(r, credit))
                amount = (c or 0.0) - abs(d or 0.0) if d is not None or c is not None else number_in(cell(r, at["AMOUNT"]))
                kind = "bank_account"
            else:
                amount, kind = number_in(cell(r, at["AMOUNT"])), "credit_card"
            if amount is None:
                continue
            posted = _loose_date(cell(r, at["POSTING"]), start, end)[1] or day
            last = {"transaction_date": day, "posting_date": posted, "description": said, "reference": reference, "amount": amount, "balance": number_in(cell(r, at["BALANCE"])), "notes": "", "line_pos": number * 10_000 + k, "statement_type": kind, "account_last4": "", **held}
            rows.append(last)
    return rows


def parse_statement(text: str, start: date | None, end: date | None, name: str = "") -> tuple[str, list[dict]]:
    """(statement type, rows), by the file's name and the markers in the text; texts of under 50 characters are empty."""
    u = text.upper()
    if "<TABLE" in u:
        rows = parse_tables(text, start, end)
        return (rows[0]["statement_type"] if rows else "bank_account"), rows
    if len(text.strip()) < 50:
        return "unknown", []
    if "credit line" in name.lower() or "line of credit" in name.lower() or "OWING ($)" in u and "PAYMENTS ($)" in u:
        return "credit_line", parse_credit_line(text, start, end)
    if "DETAILS OF YOUR ACCOUNT ACTIVITY" in u and "WITHDRAWALS" in u:
        return "bank_account", parse_bank(text, start, end)
    if rows := parse_card(text, start, end):
        return "credit_card", rows
    return "bank_account", parse_bank(text, start, end)


def parse_statements(files: DataFrame) -> DataFrame:
    """Rows of statements (name, text, and error, if they have it): schema RAW, in file and line order by (source_file, line_pos).

    A statement with an error has not been read, and gives one row that says so.
    """
    ship(files.sparkSession)
    stem = F.regexp_replace(url_decode(F.col("name")), r"\.[A-Za-z]+$", "")
    start, end = statement_period(F.col("text"))
    meta = statement_meta(stem)
    ready = files.select(stem.alias("statement_id"), F.col("name").alias("source_file"), F.coalesce("text", F.lit("")).alias("text"), start.alias("s"), F.coalesce(end, meta["statement_date"]).alias("e"), F.coalesce(meta["account_last4"], F.lit("unknown")).alias("last4"), F.lower("name").endswith(".md").alias("md"), (F.col("error") if "error" in files.columns else F.lit(None).cast("string")).alias("unread"))
    kinds = {"string": pa.string(), "date": pa.date32(), "double": pa.float64(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in RAW.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for stem_, name, text, s, e, last4_, md, unread in zip(*(c.to_pylist() for c in b.columns)):
                names_ = holders(text)
                who = {"owner": names_[0] if names_ else "Household", "role": "Holder", "household": " & ".join(names_[:2]) or "Household"}
                base = {"statement_id": stem_, "source_file": name, "source_kind": "markdown" if md else "pdf_text", **who, "statement_start": s, "statement_end": e, "error": None}
                if unread is not None:
                    out.append(base | {"error": unread})
                    continue
                try:
                    kind, rows = parse_statement(text, s, e, stem_)
                    for x in rows:
                        last4 = x.get("account_last4") or last4_
                        out.append({"statement_type": kind, "notes": "", **base, **x, "account_last4": last4, "account_label": f"{kind} • {last4}"})
                except Exception as error:  # one bad file is a row of its own, not the job's end
                    out.append(base | {"error": f"{type(error).__name__}: {error}"})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], f.type) for f in schema], schema=schema)

    return ready.mapInArrow(read, RAW)


def ingest_order(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """rows with ingest_pos: by folder (a column of rows, if any), file and line.  Files are ranked in a sorted, range-partitioned pass."""
    by = [F.coalesce(F.col(c), F.lit("")) for c in ([folder] if folder else []) + ["source_file"]]
    named = rows.withColumn("io_file", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)]))
    files = ranked(named.select("io_file").distinct(), "io_file", "io_rank")
    return named.join(files, "io_file").withColumn("ingest_pos", F.col("io_rank") * (1 << 28) + F.coalesce("line_pos", F.lit(0))).drop("io_file", "io_rank")


def statement_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text layers and Markdown files of a folder: name and text."""
    got = spark.read.option("pathGlobFilter", "*.{txt,md}").text(folder, wholetext=True)
    return got.select(url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)).alias("name"), F.col("value").alias("text"))


