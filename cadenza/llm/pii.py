"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one scan of each whole text: at-signs,
plus signs, digits, URL schemes and identifier cues.  Deterministic local parsers
expand from an anchor and validate: addresses of mail, network addresses, payment
cards (Luhn), phone numbers, then account identifiers after a cue and street
addresses before one.  Offsets are code points, end exclusive; per kind, spans are
leftmost and do not overlap, and a match that fails validation is dropped.

Edge cases: null text is empty and has no spans; repeated rows are read each; the
digest of no spans is that of the empty string; very long texts are scanned whole; on
ties the leftmost span wins; an empty table gives no rows; extra columns are kept as
they are, and added ones get a name that is still free.  One pass, no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cadenza.llm.common import fresh, nullable, read

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

#: Identifier cues; an account number follows them.
ACCOUNT_CUES = ("account no", "account number", "acct no", "iban", "passport no", "ssn", "kontonummer", "numéro de compte", "número de cuenta")
_ACCOUNT = re.compile(r"[\x20.:#-]{0,4}([A-Z]{0,2}[0-9][A-Z0-9]*(?:[\x20-]?[A-Z0-9]*[0-9][A-Z0-9]*)*)")
#: Street cues; a house number and at most four capitalised words stand before them.
STREET_CUES = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive")
_STREET = re.compile(r"(?:^|(?<=[\s,;(]))([0-9]{1,5}[A-Za-z]?\x20(?:[A-Z][\w'-]*\x20){1,4})\Z")
_LOOK_BACK = 80
#: URL schemes; a user name between scheme and at-sign is an account.
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
_USERINFO = re.compile(r"[A-Za-z0-9._%+~-]+(?::[^\s@/]*)?(?=@)")


@lru_cache(maxsize=None)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for ch in "@+0123456789":
        found.add_word(ch, ("digit" if ch.isdigit() else ch, 1))
    for cue in ACCOUNT_CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, ("account", len(form)))
    for cue in STREET_CUES:
        found.add_word("\x20" + cue, ("street", len(cue)))
    for scheme in SCHEMES:
        found.add_word(scheme, ("scheme", len(scheme)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def _is_card(s: str) -> bool:
    digits = _only_digits(s)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in s.split("."))


def _is_phone(s: str) -> bool:
    return 8 <= len(_only_digits(s)) <= 15


def find_pii(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as in KINDS, then start."""
    if not text:
        return []
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    upto = dict.fromkeys(KINDS, 0)
    in_run = -2  # last digit seen, to tell the first of a run

    def take(kind: str, start: int, end: int, good: bool) -> None:
        upto[kind] = end
        if good:
            out[kind].append((start, end))

    for last, (what, size) in _automaton().iter(text):
        at = last - size + 1
        if what == "digit":
            first, in_run = in_run != at - 1, at
            # after a match ends inside a run, matching goes on from there
            if first or upto["ip"] == at:
                if at >= upto["ip"] and (m := _IP.match(text, at)):
                    take("ip", at, m.end(), _is_ip(m[0]))
            if first or upto["card"] == at:
                if at >= upto["card"] and (m := _CARD.match(text, at)):
                    take("card", at, m.end(), _is_card(m[0]))
        elif what == "@":
            low = start = at
            while start > upto["email"] and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < low and (m := _DOMAIN.match(text, at + 1)):
                take("email", start, m.end(), True)
        elif what == "+":
            if at >= upto["phone"] and (m := _PHONE.match(text, at)):
                take("phone", at, m.end(), _is_phone(m[0]))
        elif what == "account":
            if at >= upto["account"] and (m := _ACCOUNT.match(text, last + 1)) and 6 <= len(_only_digits(m[1])) <= 30:
                take("account", m.start(1), m.end(1), True)
        elif what == "scheme":
            if at >= upto["account"] and (m := _USERINFO.match(text, last + 1)):
                take("account", m.start(), m.end(), True)
        elif what == "street":
            follow = text[last + 1 : last + 2]
            low = max(upto["address"], at - _LOOK_BACK)
            if not follow.isalnum() and (m := _STREET.search(text[low:at])):
                take("address", low + m.start(1), last + 1, True)
    return [(k, a, b) for k in KINDS for a, b in out[k]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span, or union of overlapping spans, replaced by its kind in angle brackets."""
    if not spans:
        return text
    out, upto = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= upto:
            out += [text[upto:start], f"<{kind.upper()}>"]
        upto = max(upto, end)
    return "".join([*out, text[upto:]])


def with_spans(docs: DataFrame, text_col: str = "text", name: str = "pii_spans") -> tuple[DataFrame, str]:
    """docs with an array of (kind, start, end)."""
    from pyspark.sql import types as T

    name = fresh(docs, name)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_pii(t)] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*nullable(docs.schema), T.StructField(name, T.ArrayType(span))])), name


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with personal data in the text replaced; length_col, if given, gets the new number of code points."""
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = [redact(t, find_pii(t)) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if length_at is not None:
                lengths = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                cols[length_at] = lengths.cast(batch.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, nullable(docs.schema))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_account long, n_address long"

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = [(s["kind"], s["start"], s["end"]) for s in spans]
                n = {k: sum(s[0] == k for s in spans) for k in KINDS}
                base = joined([s for s in spans if s[0] in BASE])
                rows.append((doc_id, *(n[k] for k in BASE), hashlib.sha256(base.encode()).hexdigest(), joined(spans), n["account"], n["address"]))
            names = [f.split()[0] for f in schema.split(", ")]
            types = [batch.schema.field(0).type] + [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    found, name = with_spans(docs)
    return found.select("doc_id", name).mapInArrow(run, schema)
