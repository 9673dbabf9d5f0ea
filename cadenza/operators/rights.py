"""Rules read from the rights text of a collection.

A sentence is a list of words, and each rule says which kinds of words stand how near to each
other: a negation before a board noun, a denial after one, a forbidden verb before one, or an
audience that is the only one let in.  What follows a time word is read by the date reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.dates import date_mentions
from cadenza.sources.catalogue import Catalogue

# Words by kind.
BOARD = "soundboard soundboards sbd sbds matrix matrixes"
SOURCES = "recording recordings tape tapes source sources feed feeds"
UPLOADS = "recording recordings tape tapes source sources upload uploads"
AUDIENCE = "audience aud"
VERBS = "upload post share trade circulate seed"
GRANTS = "allowed permitted acceptable accepted"
BANS = "prohibited forbidden"
TIMES = "after since from starting beginning post"
CAREFUL, CAREFUL_STEMS = "no not only except unless", "restrict remov prohibit forbid stream request"
TOPICS, TOPIC_STEMS = "audience taping", "trad stream"
#: Characters between a board noun and its denial, at most; the last two-digit year of this century.
NEAR, PIVOT = 60, 2030
WORD = "[A-Za-z0-9]+(?:'[A-Za-z]+)?"


def _of(at: str, words: str) -> str:
    return f"get(words, {at}) IN (" + ", ".join(f"'{w}'" for w in words.split()) + ")"


def _starts(word: str, stems: str) -> str:
    return "(" + " OR ".join(f"startswith({word}, '{s}')" for s in stems.split()) + ")"


def _board(at: str) -> str:
    return f"({_of(at, BOARD)} OR get(words, {at}) = 'board' AND {_of(f'{at} + 1', SOURCES)})"


def _first(start: str, condition: str) -> Column:
    """The least ``start`` of the places i where the condition holds, or null."""
    return F.expr(f"array_min(transform(filter(places, i -> coalesce({condition}, false)), i -> {start}))")


def _once(value: Column) -> Column:
    """The value as what a generator gives: columns made of it do not compute it again, for each word of a sentence."""
    return F.explode(F.array(value))


def _restriction() -> Column:
    """The word with which a restriction begins, or null."""
    denied = f"{_of('j', BANS)} OR {_of('j', GRANTS)} AND (get(words, j - 1) = 'not' OR get(words, j - 1) = 'be' AND get(words, j - 2) = 'not')"
    denied += " OR get(words, j) = 'ok' AND get(words, j - 1) = 'not' AND get(words, j - 2) = 'are'"
    # no full stop or semicolon in between, and near in characters
    between = "array_join(slice(pieces, i + 1, j - i), '')"
    near = f"j > i AND length({between}) <= length(get(pieces, i)) + {NEAR} AND NOT {between} RLIKE '[.;]'"
    verb = "IF(get(words, i - 1) = 'any', i - 2, i - 1)"
    forbidden = f"({_of(f'{verb} - 1', 'never dont')} OR get(words, {verb} - 1) = 'don\\'t' OR get(words, {verb} - 1) = 'not' AND get(words, {verb} - 2) = 'do')"
    verbs = "(" + " OR ".join(f"startswith(get(words, {verb}), '{v}')" for v in VERBS.split()) + ")"
    after = f"{_of('i', AUDIENCE)} AND (get(words, i + 1) = 'only' OR {_of('i + 1', UPLOADS)} AND get(words, i + 2) = 'only')"
    return F.coalesce(
        _first("IF(get(words, i - 1) = 'no', i - 1, i - 2)", f"{_board('i')} AND (get(words, i - 1) = 'no' OR {_of('i - 1', 'more new')} AND get(words, i - 2) = 'no')"),
        _first("i", f"{_board('i')} AND exists(places, j -> coalesce(({denied}) AND {near}, false))"),
        _first(f"{verb} - 1", f"{_board('i')} AND {verbs} AND {forbidden}"),
        _first("i", f"{after} OR get(words, i) = 'only' AND {_of('i + 1', AUDIENCE)}"),
    )


def rules(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, start, sentence: a row per rule (start '' if undated) and per sentence that a person should read.

    A sentence that restricts but whose start cannot be read is for review; an undated rule
    stands for all dated ones of its text.  Null and empty texts give no rows.
    """
    lines = F.split(F.regexp_replace(text, r"([.;!?])\s+", "$1\n"), "\n+")
    own = texts.select(key, F.explode(lines).alias("sentence")).withColumn("sentence", F.trim("sentence")).filter("sentence <> ''")
    # equal sentences are read once
    rows = own.select("sentence").distinct().withColumn("pieces", F.regexp_extract_all("sentence", F.lit(WORD + "[^A-Za-z0-9]*"), F.lit(0)))
    rows = rows.withColumn("words", F.transform("pieces", lambda p: F.lower(F.regexp_extract(p, "^" + WORD, 0))))
    rows = rows.withColumn("places", F.expr("IF(size(words) > 0, sequence(0, size(words) - 1), array())"))
    rows = rows.withColumn("hit", _once(_restriction()))
    begins = _first("i", f"i >= hit AND ({_of('i', TIMES)} OR get(words, i) = 'as' AND get(words, i + 1) = 'of')")
    rows = rows.withColumn("dated", _once(begins)).withColumn("dated", F.expr("array_join(slice(pieces, dated + 1, size(pieces)), '')"))
    word = f"w IN ({', '.join(repr(w) for w in CAREFUL.split())}) OR {_starts('w', CAREFUL_STEMS)}"
    topic = f"{_board('i')} OR {_of('i', TOPICS)} OR {_starts('get(words, i)', TOPIC_STEMS)}"
    careful = F.expr(f"exists(words, w -> {word})") & F.expr(f"exists(places, i -> coalesce({topic}, false))")
    rows = rows.select("sentence", F.col("hit").isNotNull().alias("restricts"), "dated", careful.alias("careful"))
    # the first date after the time word; a number that can only be a year, where nothing else can be read
    tails = rows.select("dated").filter("dated IS NOT NULL").distinct()
    first = date_mentions(tails, "dated", "dated", PIVOT).filter("i = 0 AND year IS NOT NULL")
    first = first.select("dated", F.make_date("year", F.coalesce("month", F.lit(1)), F.coalesce("day", F.lit(1))).cast("string").alias("start"))
    year = F.regexp_extract("dated", r"\b((?:19|20)[0-9]{2})\b", 1)
    rows = rows.join(first, "dated", "left").withColumn("start", F.coalesce("start", F.when(year != "", F.concat(year, F.lit("-01-01"))), F.lit("")))
    unread = F.col("dated").isNotNull() & (F.col("start") == "")
    rows = rows.withColumn("kind", F.when(F.col("restricts") & ~unread, "rule").when(F.col("restricts") | F.col("careful"), "review")).filter("kind IS NOT NULL")
    rows = rows.select("sentence", "kind", F.when(F.col("kind") == "rule", F.col("start")).otherwise("").alias("start"))
    rows = own.join(rows, "sentence").withColumn("sentence", F.when(F.col("kind") == "review", F.col("sentence"))).select(key, "kind", "start", "sentence").distinct()
    always = F.bool_or((F.col("kind") == "rule") & (F.col("start") == "")).over(Window.partitionBy(key))
    return rows.withColumn("always", always).filter("kind = 'review' OR start = '' OR NOT always").drop("always")


def rights_rules(c: Catalogue) -> DataFrame:
    """Rules of rights texts that are written from the orders' dates in eight ways."""
    day = lambda form: F.date_format("o_orderdate", form)
    texts = [
        F.lit("Thank you for sharing. No soundboards please."),
        F.concat(F.lit("No soundboards after "), day("yyyy-MM-dd")),
        F.concat(F.lit("Audience recordings only since "), day("MMMM d, yyyy")),
        F.concat(F.lit("No more sbds since "), day("yyyy-MM-dd"), F.lit(". Do not upload any board tapes!")),
        F.lit("All sources are welcome"),
        F.lit("No soundboards since the new label deal"),
        F.concat(F.lit("Soundboards are not ok from "), day("M/d/yy"), F.lit("\nPlease do not trade streams")),
        F.concat(F.lit("No SBD as of "), day("yyyy"), F.lit("; no matrix for shows after "), day("MMM yyyy")),
    ]
    text = F.element_at(F.array(*texts), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return rules(c.table("orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text")
