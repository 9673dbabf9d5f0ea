"""Units of texts as arrays: dates, numbered tracks, connector words, and the segments between separators, with their features.

A batch of texts is read at once.  Equal lines are read once a batch (short ones once while a worker remembers
them) and give a form: its units with what a line alone tells.  What a unit's neighbours tell is found
on the arrays of all units, end to end.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cadenza.functions.dates import read_dates

# Words that tell what a segment is, and the labels before a colon.
VENUE_WORDS = "theatre theater hall club arena ballroom auditorium stadium center centre park cafe lounge tavern".split()
SOURCE_WORDS = "sbd soundboard aud audience fm matrix dat cassette flac shn master".split()
CONNECTORS = "with feat featuring".split()
LABELS = {"source": "source", "lineage": "lineage", "venue": "venue", "artist": "artist", "date": "date", "taper": "notes", "notes": "notes"}
KINDS = ("seg", "date", "track")
SEG, DATE, TRACK = range(3)
#: All features, sorted: what a line tells, then what its place, its neighbours and the names of acts and venues tell.
OF_LINE = (
    "all_caps all_lower connector_word date_nonshow date_show has_clock has_digit has_gt numbered_track source_kw starts_lower title_case venue_word w1 w2_4 w5_7 w8p".split()
    + [f"label_{kind}" for kind in sorted(set(LABELS.values()))]
)
OF_PLACE = "after_first block_later first_in_line lib_artist lib_venue line0 line1 line2_3 line4_8 line_late next_is_connector prev_is_connector prev_line_date".split()
FEATURES = sorted(OF_LINE + OF_PLACE)
PLACE = {f: i for i, f in enumerate(FEATURES)}

# White space is ASCII in all of these.
_EMPTY, _SPACE = re.compile(r"[ \t]*"), re.compile(r"\s*", re.A)
_NUMBERED = re.compile(r"[0-9]{1,2}[ .)-]+\S", re.A)
_LABEL = re.compile(r"([A-Za-z][A-Za-z ]{0,24}):[ \t]+\S", re.A)
_LABELLED = re.compile(r"[A-Za-z][A-Za-z ]{0,24}:[ \t]+")
_CUT = re.compile(rf"[,;]| - | @ |(?<=\s)(?:(?P<word>{'|'.join(CONNECTORS)})\.?)(?=\s)", re.A | re.I)
_NOT_PLAIN, _NOT_LETTERS = re.compile("[^a-z0-9]+"), re.compile("[^A-Za-z]+")
_STARTS_LOWER, _WORD_LOWER, _CAPITAL = re.compile("[^A-Za-z]*[a-z]"), re.compile("(?:^|[^A-Za-z0-9])[a-z]"), re.compile("[A-Z]")
_DIGIT, _CLOCK = re.compile("[0-9]"), re.compile("[0-9]{1,2}:[0-9]{2}")
_VENUE, _SOURCE = (re.compile(rf"(?:^| )(?:{'|'.join(words)})(?: |$)") for words in (VENUE_WORDS, SOURCE_WORDS))
#: Lines and segments that a worker remembers, and the longest of them.
REMEMBERED, SHORT = 20_000, 200
#: Bytes of texts read at once.
AT_ONCE = 4 << 20


class Unit(NamedTuple):
    kind: int
    label: str | None
    text: str
    role: str | None  # of a date
    core: str | None  # of a segment: lower case, letters and digits with single spaces
    features: tuple[int, ...]


def _said(text: str) -> bool:
    return any((c.isalnum() if c.isascii() else unicodedata.category(c)[0] in "LN") for c in text)


def _read_segment(text: str, label: str | None) -> Unit:
    core = _NOT_PLAIN.sub(" ", text.lower()).strip(" ")
    letters, n = _NOT_LETTERS.sub("", text), core.count(" ") + 1
    upper = letters != "" and letters == letters.upper()
    found = ["w1" if n == 1 else "w2_4" if n < 5 else "w5_7" if n < 8 else "w8p"]
    marks = {
        "all_caps": upper, "all_lower": letters != "" and letters == letters.lower(), "starts_lower": _STARTS_LOWER.match(text),
        "title_case": not upper and _CAPITAL.search(text) and not _WORD_LOWER.search(text),
        "has_digit": _DIGIT.search(text), "has_clock": _CLOCK.search(text), "has_gt": ">" in text,
        "venue_word": _VENUE.search(core), "source_kw": _SOURCE.search(core), "connector_word": core in CONNECTORS,
    }
    found += [f for f, there in marks.items() if there]
    if label:
        found.append(f"label_{LABELS[label]}")
    return Unit(SEG, label, text, None, core, tuple(PLACE[f] for f in found))


_remembered_segment = lru_cache(REMEMBERED)(_read_segment)


def _segment(text: str, label: str | None) -> Unit:
    return (_remembered_segment if len(text) <= SHORT else _read_segment)(text, label)


def read_line(text: str, track: bool, latest: int) -> tuple[Unit, ...]:
    """The units of one line."""
    if track:
        return (Unit(TRACK, None, text, None, None, (PLACE["numbered_track"],)),)
    label = _LABEL.match(text)
    label = label[1].lower() if label and label[1].lower() in LABELS else None
    out, at = [], 0
    for date in [*read_dates(text, latest), None]:
        between = text[at : date.start if date else len(text)]
        if label and not at:
            between = _LABELLED.sub("", between, 1) if _LABELLED.match(between) else between
        begin, pieces = 0, []
        for cut in _CUT.finditer(between):
            pieces += [between[begin : cut.start()], cut["word"] or ""]
            begin = cut.end()
        pieces.append(between[begin:])
        out += [_segment(x, label) for x in (p.strip(" ") for p in pieces) if _said(x)]
        if date:
            show = "date_nonshow" if date.role == "handling" else "date_show"
            out.append(Unit(DATE, label, text[date.start : date.end], date.role, None, (PLACE[show],)))
            at = date.end
    return tuple(out)


_remembered = lru_cache(REMEMBERED)(read_line)


class Lines:
    """The lines of all texts that are not blank, end to end: for each its text, number (in the text), block, whether it is a track, and which of ``different`` it is.

    block: how many blank lines before it follow a text line; lines around one are of one block.  A line begins and ends
    without spaces, after a blank one without any white space.
    """

    def __init__(self, texts: pa.Array):
        if pc.any(pc.match_substring(texts, "\r")).as_py():
            texts = pc.replace_substring_regex(texts, r"\r\n?", "\n")
        rows = pc.split_pattern(texts, "\n")
        n = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = rows.flatten().dictionary_encode()
        code, written = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        empty, space = (np.array([shape.fullmatch(x) is not None for x in written], bool)[code] for shape in (_EMPTY, _SPACE))
        # as it stands, and after a blank line
        shown = [y for x in written for y in (x.strip(" "), x.lstrip(" \t\x0b\f").strip(" "))]
        full, numbered = np.array([x != "" for x in shown], bool), np.array([_NUMBERED.match(x) is not None for x in shown], bool)
        at, begin = np.arange(len(code)), np.repeat(np.cumsum(n) - n, n)
        # a blank line inside a text parts blocks; white space up to the next line goes with it
        parts = np.maximum.accumulate(np.where(empty & (at > begin), at, -1))
        parts[parts < begin] = -1
        gone = space & (parts > np.maximum.accumulate(np.where(space, -1, at)))
        after = np.zeros(len(at), bool)
        after[1:] = gone[:-1] & ~gone[1:] & (at[1:] > begin[1:])
        code = 2 * code.astype(np.int64) + after
        kept = np.flatnonzero(full[code] & ~gone)
        code, parts, self.text = code[kept], parts[kept], np.repeat(np.arange(len(n)), n)[kept]
        first = np.ones(len(kept), bool)
        first[1:] = self.text[1:] != self.text[:-1]
        start = np.maximum.accumulate(np.where(first, np.arange(len(kept)), 0))
        self.number = np.arange(len(kept)) - start
        fresh = first.copy()
        fresh[1:] |= parts[1:] != parts[:-1]
        blocks = np.cumsum(fresh)
        self.block = blocks - blocks[start]
        like = numbered[code]
        beside = np.zeros(len(kept), bool)
        beside[1:] = like[:-1] & ~first[1:]
        beside[:-1] |= like[1:] & ~first[1:]
        self.track = like & beside
        every, self.which = np.unique(2 * code + self.track, return_inverse=True)
        self.different = [(shown[x >> 1], bool(x & 1)) for x in every.tolist()]


class Units:
    """The units of all texts, end to end.

    off: the first unit of each text; for each unit its text, line, block, pos, last, kind and form;
    forms: the different units, as read; cores: the different cores, code: which of them a form has (-1: none).
    """

    def __init__(self, texts: pa.Array, latest: int):
        rows = Lines(texts)
        read = [(_remembered if len(x) <= SHORT else read_line)(x, track, latest) for x, track in rows.different]
        self.forms = [u for line in read for u in line]
        size = np.array([len(line) for line in read], np.int64)
        n = size[rows.which]
        line = np.repeat(np.arange(len(n)), n)  # of all texts, end to end
        self.text, self.line, self.block, self.last = rows.text[line], rows.number[line], rows.block[line], n[line] - 1
        self.pos = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        self.form = (np.cumsum(size) - size)[rows.which][line] + self.pos
        self.off = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.kind = np.array([u.kind for u in self.forms], np.int8)[self.form]
        codes: dict[str, int] = {}
        self.code = np.array([codes.setdefault(u.core, len(codes)) if u.core else -1 for u in self.forms], np.int64)
        self.cores = list(codes)
        dated = np.zeros(len(n) + 1, bool)
        dated[line[self.kind == DATE] + 1] = True
        self.after_date = dated[line] & (self.line > 0)  # the line before, of the same text, has a date

    def named(self) -> tuple[np.ndarray, np.ndarray]:
        """Each core that a text has, once: the core's code (ascending), and the text."""
        code = self.code[self.form]
        some = code >= 0
        return np.divmod(np.unique(code[some] * len(self.off) + self.text[some]), len(self.off))

    def features(self, known: pa.Array) -> np.ndarray:
        """Which features each unit has (units, features); known: for each text a list of (core, lib_artist, lib_venue)."""
        by_form = np.zeros((len(self.forms), len(FEATURES)), bool)
        n = [len(u.features) for u in self.forms]
        by_form[np.repeat(np.arange(len(n)), n), [f for u in self.forms for f in u.features]] = True
        has = by_form[self.form]
        seg, connector = self.kind == SEG, has[:, PLACE["connector_word"]]
        first, final = np.zeros(len(seg), bool), np.zeros(len(seg), bool)
        full = np.diff(self.off) > 0
        first[self.off[:-1][full]], final[self.off[1:][full] - 1] = True, True
        tell = {
            "line0": self.line == 0, "line1": self.line == 1, "line2_3": (self.line == 2) | (self.line == 3), "line4_8": (self.line >= 4) & (self.line <= 8), "line_late": self.line > 8,
            "block_later": self.block > 0, "first_in_line": self.pos == 0, "after_first": self.pos > 0,
            "next_is_connector": seg & np.roll(connector, -1) & ~final, "prev_is_connector": seg & np.roll(connector, 1) & ~first,
            "prev_line_date": seg & (self.pos == 0) & self.after_date,
        }
        for name, there in tell.items():
            has[:, PLACE[name]] = there
        for name, there in zip(("lib_artist", "lib_venue"), self._known(known)):
            has[:, PLACE[name]] = there
        return has

    def _known(self, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((2, len(self.form)), bool)
        n = pc.fill_null(pc.list_value_length(known), 0).to_numpy(zero_copy_only=False)
        if not n.sum():
            return out[0], out[1]
        found = known.flatten()
        code = pc.fill_null(pc.index_in(found.field("core"), value_set=pa.array(self.cores, pa.string())), -1).to_numpy(zero_copy_only=False)
        keys = np.repeat(np.arange(len(n)), n) * len(self.cores) + code
        order = np.argsort(np.where(code < 0, -1, keys), kind="stable")
        keys = np.where(code < 0, -1, keys)[order]
        own = self.code[self.form]
        want = self.text * len(self.cores) + own
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = (keys[at] == want) & (own >= 0)
        for row, name in zip(out, ("lib_artist", "lib_venue")):
            row[hit] = found.field(name).to_numpy(zero_copy_only=False)[order][at[hit]]
        return out[0], out[1]

    def of_forms(self, values: list, kind: pa.DataType) -> pa.Array:
        """A value of each form, for every unit."""
        return pa.array(values, kind).take(pa.array(self.form))


def slices(batch: pa.RecordBatch, column: int):
    """Runs of a batch whose texts have at most AT_ONCE bytes together, or one text."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, begin = np.cumsum(size), 0
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - size[begin] + AT_ONCE, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
