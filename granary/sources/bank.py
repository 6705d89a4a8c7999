"""Rows of bank statements' text layers: lines to chunks, chunks to rows, with the running balance as the state.

A chunk is what the statement prints for one day or one transaction; what it holds (kinds of rows, amounts, a balance at the end) decides how many rows it is
and which way they move.  One statement is read in order by one small machine; statements are independent.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta
from itertools import product

from granary.functions import fixed

MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
AMOUNT = re.compile(r"[\d,]+\.\d{2}")
TRAILING = re.compile(r"(?:[\d,]+\.\d{2}\s*)+$")
DATED = re.compile(r"^(\d{1,2})\s+([A-Z][a-z]{2})\s+(.+)$")
HEADING = re.compile(r"date\s+description", re.I)
REFERENCE = re.compile(r"\d{10,}$")
#: Amounts closer than this are the same one; more amounts than this are not tried with all signs.
TOLERANCE, MOST_AMOUNTS = 0.02, 8
#: A fee's last amount is a balance if it is over this and over so many times the least other one.
FEE_BALANCE, FEE_TIMES = 50, 15


def amounts_in(text: str) -> list[float]:
    return [float(a.replace(",", "")) for a in AMOUNT.findall(text)]


def split_reference(text: str) -> tuple[str, str]:
    """(description, reference): ten or more digits at the end are the reference."""
    text = " ".join(text.split())
    m = REFERENCE.search(text)
    return (text[: m.start()].strip() or text, m[0]) if m else (text, "")


def in_period(day: date, start: date | None, end: date | None) -> date:
    """A day without a year, moved into the statement's period."""
    if end and day > end:
        return _year(day, -1)
    if start and end and day < start and start.year != end.year:
        return _year(day, 1)
    return day


def _year(day: date, by: int) -> date:
    return date(day.year + by, day.month, min(day.day, 28) if day.month == 2 else day.day)


def day_of(month: str, number: str, start: date | None, end: date | None) -> date | None:
    """A day by its month's first letters and its number, in the statement's period; null without a period or where there is no such day.

    A 29th of February that the period's last year does not have is the year before's, or else the 28th.
    """
    year = (end or start).year if end or start else None
    at = MONTHS.get(month.lower()[:3])
    if year is None or at is None:
        return None
    for y, day in ((year, int(number)), *([(year - 1, 29), (year, 28)] if at == 2 and int(number) == 29 else [])):
        try:
            return in_period(date(y, at, day), start, end)
        except ValueError:
            continue
    return None


def keyword_sign(text: str) -> int:
    """1 for money in, -1 for money out, 0 where only the balance can tell; the first wording that is found decides, -1 without any."""
    t = text.lower()
    return next((sign for needles, sign in fixed.BANK_SIGNS if all(n in t for n in needles)), -1)


def resolve_signs(amounts: list[float], hints: list[int], delta: float) -> list[int] | None:
    """Signs that keep the hints and add up to the change of the balance; the first, minus before plus, of at most 256."""
    if not amounts or len(amounts) != len(hints) or len(amounts) > MOST_AMOUNTS:
        return None
    for signs in product((-1, 1), repeat=len(amounts)):
        if all(h in (0, s) for h, s in zip(hints, signs)) and abs(round(sum(s * a for s, a in zip(signs, amounts)), 2) - delta) <= TOLERANCE:
            return list(signs)
    return None


# --- lines to chunks ---


@dataclass
class Chunk:
    """Lines of one transaction, or of several that share a balance; where: the number of its first line."""

    day: date | None
    where: int
    lines: list[str] = field(default_factory=list)
    #: Whether it begins with a date, be it one that no calendar has.
    dated: bool = False

    @property
    def body(self) -> str:
        return " ".join(x for x in self.lines if x).strip()


def _goes_on(chunk: Chunk, line: str) -> bool:
    """Whether an undated line belongs to the chunk before it: it names no transaction of its own, or brings the balance of that one."""
    n = len(amounts_in(chunk.body))
    if not n or not (fixed.BANK_FOLLOW_ON.match(line) or fixed.BANK_NEW_ROW.match(line)):
        return True
    if fixed.BANK_FOLLOW_ON.match(line) or n > 1:
        return False
    # a row that prints no balance shares the next line's
    return bool(fixed.BANK_SHARES_ANY.match(line) or fixed.BANK_SHARES_ONLINE.match(line) and fixed.BANK_ONLINE.match(chunk.lines[0]))


def chunks(lines: list[str], start: date | None, end: date | None) -> list[Chunk]:
    """Dated lines begin chunks, and so do lines that name a transaction; a chunk that goes on from the page before has no day."""
    found: list[Chunk] = []
    inside, day, chunk = False, None, None
    for where, line in enumerate(lines):
        line = line.strip()
        if not line:
            continue
        if HEADING.search(line):
            inside = True
            continue
        if not inside:
            continue
        if fixed.BANK_ENDS.search(line):
            day = chunk = None
        elif fixed.BANK_BOILERPLATE.match(line):
            chunk = None
        elif m := DATED.match(line):
            day = day_of(m[2], m[1], start, end)
            chunk = Chunk(day, where, [m[3].strip()], True)
            found.append(chunk)
        elif chunk is not None and _goes_on(chunk, line):
            chunk.lines.append(line)
        else:
            # after a page's end nothing tells the day; another row of the same day keeps it
            day = day if chunk is not None else None
            chunk = Chunk(day, where, [line], day is not None)
            found.append(chunk)
    return found


def fill_days(days: list[date | None], end: date | None) -> list[date | None]:
    """Days for chunks without one: the day before the next dated one, if that is later than the last dated one, else the last, or the period's end."""
    following: list[date | None] = []
    nearest = None
    for day in reversed(days):
        following.append(nearest)
        nearest = day or nearest
    out, before = [], None
    for day, after in zip(days, reversed(following)):
        if day is None:
            guess = after - timedelta(days=1) if after else None
            out.append(guess if guess and not (before and guess <= before) else before or end)
        else:
            out.append(day)
            before = day
    return out


# --- chunks to rows ---

#: (description, signed amount, balance after it or None)
Row = tuple[str, float, float | None]


class Account:
    """The running balance, and what each kind of chunk makes of it."""

    def __init__(self, balance: float):
        self.balance = balance

    def _to(self, said: str, amount: float, balance: float | None) -> list[Row]:
        """One row after which the balance is as printed, or moved by the amount."""
        self.balance = round(self.balance + amount, 2) if balance is None else balance
        return [(said, round(amount, 2), balance)]

    def fee(self, body: str, a: list[float]) -> list[Row]:
        printed = len(a) > 1 and a[-1] > FEE_BALANCE and a[-1] > FEE_TIMES * min(a[:-1])
        return self._to(strip(body, len(a)), -(min(a[:-1]) if printed else max(a)), a[-1] if printed else None)

    def charge(self, body: str, a: list[float]) -> list[Row]:
        return self._to(strip(body, 2), -a[-2], a[-1])

    def debit(self, body: str, a: list[float]) -> list[Row]:
        return self._to(strip(body, 2), -a[0], a[1])

    def credit(self, body: str, a: list[float]) -> list[Row]:
        return self._to(strip(body, 2), a[0], a[1])

    def several(self, body: str, a: list[float]) -> list[Row]:
        """A row for each amount but the last, which is the balance, each with the text before it; if no signs fit, one row of the whole change."""
        moved, texts, at = round(a[-1] - self.balance, 2), [], 0
        for m in list(AMOUNT.finditer(body))[:-1]:
            texts.append(body[at : m.start()].strip())
            at = m.end()
        signs = resolve_signs(a[:-1], [keyword_sign(t) for t in texts], moved)
        if signs is None:
            return self._to(strip(body, len(a)) or body, moved, a[-1])
        self.balance = a[-1]
        return [(t, round(s * x, 2), a[-1] if i == len(signs) - 1 else None) for i, (t, s, x) in enumerate(zip(texts, signs, a))]

    def change(self, body: str, a: list[float]) -> list[Row]:
        said = strip(body, 2)
        own = any(w in said.lower() for w in fixed.BANK_OWN_AMOUNT)
        return self._to(said, -a[-2] if own else a[-1] - self.balance, a[-1])

    def worded(self, body: str, a: list[float]) -> list[Row]:
        said = strip(body, min(2, len(a)))
        return self._to(said, (keyword_sign(said) or -1) * a[-2 if len(a) > 1 else -1], None)


def strip(body: str, count: int) -> str:
    """body without so many amounts at its end."""
    for _ in range(count):
        body = re.sub(r"[\d,]+\.\d{2}\s*$", "", body).strip()
    return body


def _apart(a: list[float]) -> bool:
    return len(a) > 1 and abs(a[-1] - a[-2]) > TOLERANCE


#: Kinds of chunks in order: whether a lower-case text and its amounts are of the kind, and what reads it.
KINDS: tuple[tuple[Callable[[str, list[float]], bool], Callable[[Account, str, list[float]], list[Row]]], ...] = (
    (lambda t, a: "partial monthly fee" in t, Account.fee),
    (lambda t, a: len(a) > 1 and ("loan interest" in t or "interest charge" in t), Account.charge),
    (lambda t, a: len(a) == 2 and "bill payment" in t, Account.debit),
    (lambda t, a: len(a) == 2 and "item returned" in t and "nsf" in t, Account.credit),
    (lambda t, a: len(a) == 2 and "insurance" in t, Account.debit),
    (lambda t, a: len(a) > 2 and _apart(a), Account.several),
    (lambda t, a: _apart(a), Account.change),
    (lambda t, a: True, Account.worded),
)


def opening_balance(lines: list[str]) -> float:
    """The last amount of the first line that states the opening balance; 0 without one."""
    stated = next((x for x in lines if x.strip().lower().startswith("opening balance")), "")
    return next(iter(amounts_in(stated)[-1:]), 0.0)


def parse_bank(text: str, start: date | None, end: date | None) -> list[dict]:
    """Rows from where the account's activity begins, in the order of their lines."""
    at = text.lower().find("details of your account activity")
    if at < 0:
        return []
    first, lines = text[:at].count("\n"), text[at:].splitlines()
    found = chunks(lines, start, end)
    account, rows = Account(opening_balance(lines)), []
    for chunk, guess in zip(found, fill_days([c.day for c in found], end)):
        day = chunk.day if chunk.dated else guess
        body, a = chunk.body, amounts_in(chunk.body)
        if not a:
            continue
        read = next(read for fits, read in KINDS if fits(body.lower(), a))
        for i, (said, amount, balance) in enumerate(read(account, body, a)):
            description, reference = split_reference(said)
            rows.append({"transaction_date": day, "posting_date": None, "description": description, "reference": reference, "account_last4": "", "amount": amount, "balance": balance, "line_pos": (first + chunk.where) * 16 + i})
    return rows
