"""Dates as people write them: every mention in a text, and what the mentions say together.

A text is cut into tokens, each of one kind (year, one or two digits, month word, sign, ...), and
the kinds are read as a string.  A notation is a shape over that string, so a notation never sees
characters, and spacing, ordinals and month names are settled once, by the tokens.  Notations are
tried from the most to the least specific, and tokens that one has taken are blank for the next.

A part that is not written stays null; nothing is filled from today's date.
"""

from __future__ import annotations

import calendar
import datetime
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Month words, words near a date that make it one of handling and not of the event, words that make it the event's.
MONTHS = "january february march april may june july august september october november december".split()
SHORT_MONTHS = "jan feb mar apr may jun jul aug sep sept oct nov dec".split()
HANDLING = (
    "transfer|seed|exact audio copy|extraction|log file|logfile|upload|riped|ripped|encod|convert|burn|digitis|digitiz|"
    "remaster|mastered|dubbed|copied|posted|created|flacd|flac'd|checksum|updated"
).split("|")
HANDLING_WORDS, HANDLING_STARTS = ["eac"], ["shnd", "shn'd"]
EVENT = "perform recorded recording concert taped played".split()
EVENT_WORDS, EVENT_WEAK_BEFORE = ["show", "live"], ["date"]
#: How far from a date a word counts, in its line.
REACH = 30
FIRST_YEAR = 1900

_MONTH = {name: i + 1 for i, name in enumerate(MONTHS)} | {name: MONTHS.index(next(m for m in MONTHS if m.startswith(name[:3]))) + 1 for name in SHORT_MONTHS}
#: Kinds of words and signs; all else is "w".  Digits: Y year, n one, d two, F four that are no year, N others; q two unknown digits, Q four.
_WORDS = {"of": "f", "or": "a", "and": "R", "thru": "r", "through": "r", "to": "r", "until": "u", "xx": "x", "st": "o", "nd": "o", "rd": "o", "th": "o"} | dict.fromkeys(_MONTH, "M")
_SIGNS = {"-": "-", "–": "e", "—": "e", "&": "&", ".": ".", "/": "/", ",": ",", ":": ":", "'": "'", " ": " ", "\t": " ", "??": "q", "????": "Q"}
#: One, two or four digits: no notation is without them.
_DIGITS = re.compile("(?<![0-9])(?:[0-9]{1,2}|[0-9]{4})(?![0-9])")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\?+|.", re.S)


class Mention(NamedTuple):
    start: int
    end: int
    year: int | None
    month: int | None
    day: int | None
    end_day: int | None = None
    other_month: int | None = None  # the day-first reading of a numeric date that has two
    other_day: int | None = None
    ambiguous: bool = False
    role: str | None = None  # event, handling, or unknown


def _kind(token: str) -> str:
    if token.isascii() and token.isdigit():
        return {1: "n", 2: "d", 4: "Y" if token[:2] in ("19", "20") else "F"}.get(len(token), "N")
    if token.isalpha():
        return _WORDS.get(token.lower(), "w")
    return _SIGNS.get(token, "w")


# Shapes: a group's name says what its token is; digits before or after, a colon (a time) or a further separator rule a shape out.
_ALONE = r"(?<![ndYFN.:/\-])"
_PART = r"[nd]"
_SHAPES = [
    ("iso", r"(?<![ndYFN.\-/])(?P<y>Y)[-./](?P<m>[dq])(?:[-./](?P<d>[ndq]))?(?P<until> *[ru\-e] *Y[-./][nd][-./][nd])?"),
    ("spaced", r"(?<![ndYFN.\-/])(?P<y>Y) (?P<m>d) (?P<d>d)(?!:)"),
    ("numeric", _ALONE + r"(?P<one>[ndqx])[-./](?P<two>[ndqx])[-./](?P<any>[YFdQq])(?!:)"),
    ("year first", _ALONE + rf"(?P<y>Y)[ ,]+(?P<mon>M)[ .]*(?P<d>{_PART})o?"),
    ("month day", rf"(?P<mon>M)\.? *(?P<d>{_PART})o?(?: *(?:(?P<range>[-eRr&])|(?P<or>a)) *(?P<d2>{_PART})o?)?(?: *,? *(?:(?P<y>Y)(?!:)|'(?P<yy>d)))?"),
    ("day month", _ALONE + rf"(?P<d>{_PART})o?[ .\-]*(?:f +)?(?P<mon>M)(?:[ .,]*(?P<y>Y)(?!:))?"),
    ("month year", r"(?P<mon>M)[ .,]*(?P<y>Y)(?!:)"),
    ("year", r"(?<![ndYFN.:/\-,])(?P<y>Y)(?!:|[.\-/][ndYFN])"),
]
_SHAPES = [(name, re.compile(shape)) for name, shape in _SHAPES]


def _either(parts: list[str], words: list[str], starts: list[str] = ()) -> re.Pattern:
    return re.compile("|".join([*map(re.escape, parts), *(rf"\b{re.escape(w)}\b" for w in words), *(rf"\b{re.escape(w)}" for w in starts)]), re.I)


_IS_HANDLING, _IS_EVENT, _IS_WEAK = _either(HANDLING, HANDLING_WORDS, HANDLING_STARTS), _either(EVENT, EVENT_WORDS), _either([], EVENT_WEAK_BEFORE)


def _role(text: str, start: int, end: int) -> str | None:
    """The nearest telling word before the date in its line decides, else one after it."""
    line = text.rfind("\n", 0, start) + 1
    stop = text.find("\n", end)
    before, after = text[max(line, start - REACH) : start], text[end : min(len(text) if stop < 0 else stop, end + REACH)]
    last = {role: max((m.end() for m in sign.finditer(before)), default=-1) for role, sign in (("handling", _IS_HANDLING), ("event", _IS_EVENT))}
    if max(last.values()) >= 0:
        return "handling" if last["handling"] > last["event"] else "event"
    if _IS_HANDLING.search(after):
        return "handling"
    return "event" if _IS_EVENT.search(after) or _IS_WEAK.search(before) else None


def _possible(year: int | None, month: int | None, day: int | None, latest: int) -> bool:
    if year is not None and not FIRST_YEAR <= year <= latest:
        return False
    if month is not None and not 1 <= month <= 12:
        return False
    return day is None or 1 <= day <= (calendar.monthrange(year or 2000, month)[1] if month else 31)


def _numeric(one: str, two: str, last: str, latest: int) -> dict | None:
    """Three numbers: what each can be decides; month first where both readings hold, the other one is kept."""
    number = lambda t: int(t) if t.isdigit() else None
    a, b = number(one), number(two)
    if a is not None and a > 31 and b is not None and last.isdigit() and len(last) == 2 and 1 <= b <= 12:
        return {"year": 1900 + a, "month": b, "day": int(last)}
    year = number(last)
    if year is not None and len(last) == 2:
        year = pivoted(year, latest)
    out = {"year": year, "month": None, "day": None}
    if a is None:
        # nothing says which of day and month is known
        return None if year is None else out | {"ambiguous": b is not None}
    if b is None:
        return out | ({"month": a} if a <= 12 else {"day": a})
    if a > 12 and b > 12:
        return None
    if a > 12:
        return out | {"month": b, "day": a}
    out |= {"month": a, "day": b}
    return out | {"other_month": b, "other_day": a} if b <= 12 and a != b else out


def pivoted(year: int, latest: int) -> int:
    """A two-digit year, none of them after the latest."""
    return (2000 if year <= latest % 100 else 1900) + year


def read_dates(text: str | None, latest: int) -> list[Mention]:
    """All mentions in text order."""
    if not text or not _DIGITS.search(text):
        return []
    tokens = list(_TOKEN.finditer(text))
    kinds = "".join(_kind(t[0]) for t in tokens)
    found: list[Mention] = []
    for name, shape in _SHAPES:
        if name == "year" and "Y" not in kinds:
            break
        for hit in shape.finditer(kinds):
            at = {k: tokens[hit.start(k)][0] for k, v in hit.groupdict().items() if v and k != "until"}
            number = lambda k: int(at[k]) if k in at and at[k].isdigit() else None
            first, last = hit.span()
            if name == "numeric":
                parts = _numeric(at["one"], at["two"], at["any"], latest)
            else:
                parts = {"year": number("y"), "month": _MONTH[at["mon"].lower()] if "mon" in at else number("m"), "day": number("d")}
                if "yy" in at:
                    parts["year"] = pivoted(number("yy"), latest)
            if parts is None or not _possible(parts["year"], parts["month"], parts["day"], latest):
                continue
            if name == "iso" and hit["until"]:
                y, m, d = (int(t[0]) for t in tokens[hit.start("until") : last] if t[0].isdigit())
                if parts["day"] and (y, m) == (parts["year"], parts["month"]) and d > parts["day"]:
                    parts["end_day"] = d
                else:
                    last = hit.start("until")
            if "or" in at:
                parts |= {"day": None, "ambiguous": True}
            elif "d2" in at and number("d2") > parts["day"] and _possible(parts["year"], parts["month"], number("d2"), latest):
                parts["end_day"] = number("d2")
            start, end = tokens[first].start(), tokens[last - 1].end()
            found.append(Mention(start, end, **parts, role=_role(text, start, end)))
            kinds = kinds[:first] + " " * (last - first) + kinds[last:]
    return settled(sorted(found))


def settled(mentions: list[Mention]) -> list[Mention]:
    """Day-first readings where a mention without two readings writes only that reading's month; in text order."""
    known = {m.month for m in mentions if m.other_month is None and m.month}
    out = []
    for m in mentions:
        if m.other_month is not None:
            if m.other_month in known and m.month not in known:
                m = m._replace(month=m.other_month, day=m.other_day, other_month=m.month, other_day=m.day)
            known.add(m.month)
        out.append(m)
    return out


_FIELDS = [(f, {"ambiguous": pa.bool_(), "role": pa.string()}.get(f, pa.int32())) for f in Mention._fields]


def date_mentions(texts: DataFrame, key: str, text: str, latest: int | None = None) -> DataFrame:
    """key, i, and the fields of Mention: a row per mention, i counting from 0 in each text.

    Null and empty texts, and texts without dates, give no rows.  ``latest`` is the last year
    that can be meant (this year by default), and the pivot of two-digit years.
    """
    key_type = texts.schema[key].dataType.simpleString()
    last = latest or datetime.date.today().year

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, i, m) for r, t in enumerate(batch.column(1).to_pylist()) for i, m in enumerate(read_dates(t, last))]
            of, number = pa.array([r for r, _, _ in rows], pa.int64()), pa.array([i for _, i, _ in rows], pa.int32())
            fields = [pa.array([getattr(m, f) for _, _, m in rows], kind) for f, kind in _FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), number, *fields], names=[key, "i", *(f for f, _ in _FIELDS)])

    kinds = {pa.bool_(): "boolean", pa.string(): "string", pa.int32(): "int"}
    schema = f"`{key}` {key_type}, i int, " + ", ".join(f"`{f}` {kinds[k]}" for f, k in _FIELDS)
    return texts.select(key, text).mapInArrow(run, schema)


def _known(year: Column, month: Column, day: Column) -> Column:
    """Which parts are known, as bits: 4 year, 2 month, 1 day."""
    return sum((F.when(c.isNotNull(), bit).otherwise(0) for c, bit in ((year, 4), (month, 2), (day, 1))), F.lit(0))


def _code(bits: Column) -> Column:
    """The parts that ``bits`` names, as one number."""
    part = lambda c, bit, by: F.when(bits.bitwiseAND(bit) > 0, F.col(c) * by).otherwise(0)
    return part("year", 4, 10000) + part("month", 2, 100) + part("day", 1, 1)


def voted_dates(mentions: DataFrame, key: str) -> DataFrame:
    """key, year, month, day, end_day, ambiguous: the event's date that a text's mentions support.

    The most precise mention leads, and each mention that states a common part and contradicts none adds
    to it; an earlier mention with a month in another year takes from it.  Handling dates do not
    count.  The leader's missing year, or missing month and day, come from the best mention that fits.

    Agreement is counted, not compared pair by pair: a mention adds one for each set of its parts, and
    another looks up, for each set of parts that others can know, those they have in common.
    """
    rows = mentions.filter("role IS NULL OR role <> 'handling'").withColumn("known", _known(F.col("year"), F.col("month"), F.col("day"))).filter("known > 0")
    # what a mention adds (n = 1) and what it looks up (n = 0) are cells of one table, dealt by its text alone: one shuffle for all steps
    cell = lambda theirs, common, n: F.struct(theirs.alias("theirs"), common.alias("common"), F.lit(n).alias("n"))
    known = F.col("known")
    adds = F.transform(F.expr("filter(sequence(1, 7), s -> (s & known) = s)"), lambda s: cell(known, s, 1))
    asks = F.transform(F.expr("filter(sequence(1, 7), s -> (s & known) > 0)"), lambda s: cell(s, s.bitwiseAND(known), 0))
    # the number is given, for cells are many times what is shuffled
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = rows.repartition(parts, key).select(key, "i", "year", "month", "day", "end_day", "ambiguous", "known", F.explode(F.concat(adds, asks)).alias("cell"))
    cells = cells.select("*", "cell.*").drop("cell").withColumn("code", _code(F.col("common")))
    cells = cells.withColumn("like", F.sum("n").over(Window.partitionBy(key, "theirs", "common", "code"))).filter("n = 0")
    rows = cells.groupBy(key, "i", "year", "month", "day", "end_day", "ambiguous", "known").agg((F.sum("like") - 1).alias("agree"))
    earlier = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    dated = F.when(F.col("year").isNotNull() & (F.bit_count("known") >= 2), F.col("year"))
    late = (F.min(dated).over(earlier) != F.col("year")) | (F.max(dated).over(earlier) != F.col("year"))
    rows = rows.withColumn("score", F.bit_count("known") * 10 + F.col("agree") * 3 - F.when(late, 15).otherwise(0))
    rank = [F.col("score").alias("score"), (-F.col("i")).alias("place")]
    parts = ["year", "month", "day", "end_day", "ambiguous"]
    rows = rows.withColumn("lead", F.max(F.struct(*rank, *parts)).over(Window.partitionBy(key)))
    same = lambda c: F.col(f"lead.{c}").isNull() | F.col(c).isNull() | (F.col(c) == F.col(f"lead.{c}"))
    year = F.max(F.when(F.col("year").isNotNull() & same("month") & same("day"), F.struct(*rank, "year")))["year"]
    rest = F.max(F.when(F.col("year").isNull() & F.col("month").isNotNull(), F.struct(*rank, "month", "day")))
    out = rows.groupBy(key, "lead").agg(year.alias("a_year"), rest.alias("a_rest"))
    lead = lambda c: F.col(f"lead.{c}")
    bare = lead("year").isNotNull() & lead("month").isNull()
    return out.select(
        key,
        F.coalesce(lead("year"), "a_year").alias("year"),
        F.when(bare, F.col("a_rest.month")).otherwise(lead("month")).alias("month"),
        F.when(bare, F.coalesce("a_rest.day", lead("day"))).otherwise(lead("day")).alias("day"),
        lead("end_day").alias("end_day"),
        lead("ambiguous").alias("ambiguous"),
    )
