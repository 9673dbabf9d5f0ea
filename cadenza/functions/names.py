"""Names of titles, folders and files, as column expressions over their words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stay small in a title; words in brackets that are no writer's name.
SMALL_WORDS = "a an the and but or for nor at by in of on to up as is it if so vs".split()
NO_NAMES = (
    "tuning banter applause crowd intro outro announcement announcements interview interviews live reprise instrumental acoustic electric unplugged interlude jam improv "
    "improvisation alt alternate version take edit mix remix excerpt incomplete unfinished unreleased demo rehearsal soundcheck encore bonus early late first second "
    "part pt set disc side cd medley segue false start fade in out cut ending beginning partial sbd aud matrix fm"
).split()
#: Bases before a bracketed name that are no song.
NO_SONGS = "tuning banter applause crowd intro outro announcement announcements interview encore soundcheck".split()
# Makers by name, with or without a model's number; short marks that need one; marks of a source.
MAKERS = (
    "schoeps neumann sennheiser nakamichi nak oktava earthworks josephson milab naiant busman mbho gefell beyerdynamic audio-technica lunatec nagra "
    "tascam marantz apogee edirol sony dat"
).split()
MARKS = "akg at km cmc mk dpa ca sp ua sbm pcm dr jb".split()
SOURCES = "sbd aud mtx fm".split()
# Names that a file system keeps for itself, and the longest path of a folder and file.
RESERVED = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]
LONGEST_PATH, SPARE, SHORTEST = 200, 4, 12
# The line that leads from the composite to a grade.
GRADE_SLOPE, GRADE_INTERCEPT = 0.5956, 40.592
_TAIL = "[.,;:!?)\"'’”]+$"


def _in(word: Column, words: list[str]) -> Column:
    return word.isin(*words)


def _word(word: Column, place: Column) -> Column:
    """One word of a title."""
    core = F.regexp_replace(word, _TAIL, "")
    first = F.concat(F.regexp_extract(word, r"^([^\p{L}]*)", 1), F.upper(F.regexp_extract(word, r"^[^\p{L}]*(\p{L})", 1)), F.regexp_extract(word, r"^[^\p{L}]*\p{L}(.*)$", 1))
    first = F.when(word.rlike(r"\p{L}"), first).otherwise(word)
    # the letter behind a pattern's first part becomes a capital
    raised = lambda w, lead: F.concat(F.regexp_extract(w, f"^({lead})", 1), F.upper(F.regexp_extract(w, rf"^{lead}(\p{{L}})", 1)), F.regexp_extract(w, rf"^{lead}\p{{L}}(.*)$", 1))
    mc = r"[^\p{L}\p{N}]*[Mm][Cc]"
    mc_name = first.rlike(rf"^{mc}\p{{L}}[^.,;:!?)\"'’”]")
    scottish = raised(F.concat(F.regexp_extract(first, r"^([^\p{L}\p{N}]*[Mm])", 1), F.lit("c"), F.regexp_extract(first, rf"^{mc}(.*)$", 1)), mc)
    first = F.when(mc_name, scottish).otherwise(first)
    irish = r"[^\p{L}\p{N}]*[^\P{L}iI]['’]"
    first = F.when(first.rlike(rf"^{irish}\p{{L}}"), raised(first, irish)).otherwise(first)
    parts = F.transform(F.split(first, "-"), lambda p, i: F.when((i > 0) & p.rlike(r"^\p{L}"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))).otherwise(p))
    small = (place > 0) & core.rlike(r"^[\p{L}\p{N}]") & _in(F.lower(core), SMALL_WORDS)
    return (
        F.when(word.rlike(r"(?i)^\d+(st|nd|rd|th)[^\p{L}\p{N}_]*$"), F.lower(word))
        .when(word.rlike(r"^[^\p{L}\p{N}_]*\p{L}(\.\p{L})+\.?[^\p{L}\p{N}_]*$"), F.upper(word))
        .when(small, F.lower(word))
        .otherwise(F.array_join(parts, "-"))
    )


def title_case(text: Column) -> Column:
    """Words with capitals, small words small, initials, Mc and O' names and parts after hyphens too; text of one case is lower-cased before, other words keep their tails."""
    one_case = text.rlike(r"\p{L}") & ((text == F.upper(text)) | (text == F.lower(text)))
    words = F.filter(F.split(F.when(one_case, F.lower(text)).otherwise(text), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, _word), " ")


def songwriter(title: Column) -> tuple[Column, Column]:
    """The title without one writer's name in brackets at its end, and the name; several writers, notes and no-songs stay as they are."""
    inside = F.regexp_extract(title, r"\s*\(([^()]+)\)\s*$", 1)
    words = F.filter(F.split(inside, r"\s+"), lambda w: w != "")
    base = F.trim(F.regexp_replace(title, r"\s*\([^()]+\)\s*$", ""))
    names = F.size(words).between(1, 3) & F.forall(words, lambda w: w.rlike(r"^[A-Z][A-Za-z'’.\-]*$") & ~_in(F.regexp_replace(F.lower(w), "^[.,]+|[.,]+$", ""), NO_NAMES))
    good = (inside != "") & names & (base != "") & ~_in(F.lower(base), NO_SONGS)
    return F.when(good, base).otherwise(title), F.when(good, F.array_join(words, " "))


def _tokens(name: Column) -> Column:
    whole = F.regexp_replace(name, "(?i)(audio)-(technica)", "$1\u0001$2")
    return F.transform(F.filter(F.split(whole, r"[()\[\]._\-\s>]+"), lambda t: t != ""), lambda t: F.replace(t, F.lit("\u0001"), F.lit("-")))


def gear(name: Column) -> Column:
    """Equipment that a folder's name names, as written, each once."""
    model = r"\d{1,4}[a-z]?"
    found = F.filter(_tokens(name), lambda t: t.rlike(rf"(?i)^(({'|'.join(MAKERS)})({model})?|({'|'.join(MARKS)}){model})$"))
    return F.filter(found, lambda t, i: F.array_position(F.transform(found, F.lower), F.lower(t)) == i + 1)


def named_source(name: Column) -> Column:
    """The last mark of a source in a folder's name, in capitals."""
    return F.upper(F.try_element_at(F.filter(_tokens(name), lambda t: _in(F.lower(t), SOURCES)), F.lit(-1)))


def seeder_number(name: Column) -> Column:
    """The last number of three to seven digits between dots, hyphens and underscores that is no year."""
    numbers = F.filter(F.split(name, "[._-]"), lambda t: t.rlike(r"^\d{3,7}$") & ~t.cast("string").rlike(r"^0*(19|20)\d\d$"))
    return F.try_element_at(numbers, F.lit(-1)).try_cast("int")


def safe_name(text: Column, whole: bool = True) -> Column:
    """A name that every file system takes; a legal one comes back as it is.  ``whole``: nothing follows it, so that it ends in no space or dot."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f]", "")
    t = F.regexp_replace(t, r"^\s*[<>|:]+\s*|\s*[<>|:]+\s*$", "")
    t = F.regexp_replace(t, r"\s*[<>|:]+\s*", " - ")
    t = F.translate(F.translate(t, '"/\\', "'--"), "?*", "")
    t = F.regexp_replace(t, r"[ .]+$", "") if whole else t
    return F.when(_in(F.lower(F.trim(F.substring_index(t, ".", 1))), RESERVED), F.concat(t, F.lit("_"))).otherwise(t)


def fitted(name: Column, folder: Column, longest: int = LONGEST_PATH) -> Column:
    """A file's name cut between words so that folder and name fit; folders before the name and the ending stay.

    An act's name that the file repeats from the folder goes first, as it says least.
    """
    head = F.regexp_extract(name, r"^(.*/)[^/]*$", 1)
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    ending = F.regexp_extract(base, r"[^.](\.[^.]*)$", 1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ending))
    used = F.when(F.coalesce(F.length(folder), F.lit(0)) > 0, F.length(folder) + 1).otherwise(0) + F.length(head)
    room = F.greatest(F.lit(longest) - used - F.length(ending) - SPARE, F.lit(SHORTEST))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0)))
    act = words(F.substring_index(F.coalesce(folder, F.lit("")), "/", 1))
    parts = F.split(stem, " - ")
    says = lambda p: F.size(F.array_intersect(words(p), act))
    repeats = F.transform(parts, lambda p, i: (i > 0) & (i < F.size(parts) - 1) & (F.size(words(p)) > 0) & (says(p) >= F.least(F.lit(2), F.size(act))) & (says(p) * 2 >= F.size(words(p))))
    at = F.array_position(repeats, True)
    short = F.when((F.size(act) > 0) & (at > 0), F.array_join(F.filter(parts, lambda p, i: i + 1 != at), " - ")).otherwise(stem)
    start = F.substring(short, F.lit(1), room)
    space = F.length(start) - F.length(F.substring_index(start, " ", -1)) - 1
    start = F.when(space >= room * 0.6, F.substring(start, F.lit(1), space)).otherwise(start)
    start = F.regexp_replace(start, r"[ \-.,;(]+$", "")
    cut = F.when(F.length(stem) <= room, stem).when(F.length(short) <= room, short).otherwise(start)
    return F.concat(head, cut, ending)


def whole_year(year: Column, *texts: Column) -> tuple[Column, Column]:
    """A two-digit year's century and how it is known: by each text's years with the same end if they are of one century, else as 00 to 26 of this one and others of the last."""
    out, how = F.when(year >= 100, year), F.when(year >= 100, "written")
    ends = F.lpad(year.cast("string"), 2, "0")
    for i, text in enumerate(texts):
        # whether the text has the year of that century, as a number of its own
        last, this = (F.coalesce(F.regexp(text, F.concat(F.lit(rf"(?<!\d){c}"), ends, F.lit(r"(?!\d)"))), F.lit(False)) for c in (19, 20))
        one = F.when(last & ~this, year + 1900).when(this & ~last, year + 2000)
        out, how = F.coalesce(out, one), F.coalesce(how, F.when(one.isNotNull(), f"text {i + 1}"))
    return F.coalesce(out, F.when(year <= 26, year + 2000).otherwise(year + 1900)), F.when(year.isNotNull(), F.coalesce(how, F.lit("inferred")))


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD of what is known; null without a year."""
    known = lambda c: F.coalesce(c, F.lit(0)) > 0
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(known(year), F.concat(year.cast("string"), F.when(known(month), F.concat(F.lit("-"), two(month), F.when(known(day), F.concat(F.lit("-"), two(day))).otherwise(""))).otherwise("")))


def predicted_grade(composite: Column) -> Column:
    """Grade points, 0 to 100."""
    return F.when(composite.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), composite * GRADE_SLOPE + GRADE_INTERCEPT)))


def binned(value: Column, bins: list[tuple[float | None, float | None, float]], otherwise: Column) -> Column:
    """The p of the first bin (from, below, p) that holds the value; a bound that is None is open."""
    out = F.when(F.lit(False), 0.0)
    for low, high, p in bins:
        inside = F.lit(True) if low is None else value >= low
        out = out.when(value.isNotNull() & inside if high is None else inside & (value < high), p)
    return out.otherwise(otherwise)
