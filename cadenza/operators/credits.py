"""Who recorded, transferred and mastered a show, from free text.

A credit is a run of role words that ends in "by" or, for some, in a colon; the name follows.  The
run says the roles: "recorded and mastered by" gives two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.sources.catalogue import Catalogue

# Words of each role, words that stand among them, labels before a colon, where a name stops, and what is no name.
ROLES = {"recording": "recorded recording taped taper", "transfer": "transferred transfered transfer xfer xfered", "mastering": "mastered mastering master"}
AMONG = "and edited edit mic mics source engineer"
LABELS = {"taper": r"^\s*[:\-–]", "transfer": r"^\s*:", "mastering": r"^\s*:", "engineer": r"^\s*:"}
STOP_WORDS, STOP_SIGNS = "using with on at from", r'[,;(\["]|->|>|\s[-–—]\s'
NO_NAMES = (
    "mic mics microphone microphones dat sony neumann schoeps akg dpa nakamichi nak sennheiser sbd aud fm mtx matrix cd flac shn wav eac soundboard audience cassette reel dsd tascam "
    "marantz oade naiant sound devices zoom edirol roland pcm cmc cardioid omni khz bit tape deck preamp pre mixer board master source unknown unk n/a na none tbd lineage transfer "
    "audacity wavelab edit soundforge mk ck usb minidisc md"
).split()
LONGEST = 40


def person(text: Column) -> Column:
    """The name with which a text begins, or null: gear, models, sources and what is too long are no names."""
    stops = rf"{STOP_SIGNS}|\s({STOP_WORDS.replace(' ', '|')})\s"
    text = F.regexp_replace(text, r"^[\s:\-–—]+", "")
    text = F.regexp_replace(F.regexp_replace(text, rf"(?i)({stops}).*$", ""), r"\s+", " ")
    text = F.regexp_replace(text, r"^[\s.:;\-–—*_']+|[\s.:;\-–—*_']+$", "")
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9/]+"), F.lit(0))
    model = F.exists(words, lambda w: w.rlike("[0-9]") & w.rlike("[a-z]") & (F.length(w) <= 7))
    good = text.rlike("[A-Za-z]") & (F.length(text) <= LONGEST) & ~text.contains("=") & ~F.arrays_overlap(words, F.array(*map(F.lit, NO_NAMES))) & ~model
    return F.when(good, text)


def credits(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, role, name: the first name of each role in a text.  Null and empty texts have none."""
    rows = texts.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line", "said"))
    rows = rows.withColumn("pieces", F.regexp_extract_all("said", F.lit("[A-Za-z0-9]+[^A-Za-z0-9]*"), F.lit(0))).filter("size(pieces) > 1")
    rows = rows.withColumn("words", F.transform("pieces", lambda p: F.lower(F.regexp_extract(p, "^[A-Za-z0-9]+", 0))))
    rows = rows.withColumn("after", F.transform("pieces", lambda p: F.regexp_replace(p, "^[A-Za-z0-9]+", "")))
    rows = rows.select(key, "line", "pieces", "words", "after", F.posexplode("words").alias("at", "word"))
    labelled = F.coalesce(*(F.when(F.col("word") == w, F.get("after", F.col("at")).rlike(sign)) for w, sign in LABELS.items()), F.lit(False))
    rows = rows.filter((F.col("word") == "by") | labelled)
    # the words before that belong together: role words and those among them, with nothing but a sign that joins them
    every = [*AMONG.split(), *(w for words in ROLES.values() for w in words.split())]
    last = F.when(F.col("word") == "by", F.col("at") - 1).otherwise(F.col("at"))
    quoted = ", ".join(f"'{w}'" for w in every)
    joined = f"forall(sequence(j, last), k -> get(words, k) IN ({quoted}) AND (k = last OR get(after, k) RLIKE '^\\\\s*[&+/,]?\\\\s*$'))"
    run = F.expr(f"filter(sequence(0, greatest(last, 0)), j -> last >= 0 AND {joined})")
    rows = rows.withColumn("last", last).withColumn("run", F.transform(run, lambda j: F.get("words", j)))
    roles = F.array_compact(F.array(*(F.when(F.arrays_overlap("run", F.array(*map(F.lit, words.split()))), role) for role, words in ROLES.items())))
    name = person(F.array_join(F.slice("pieces", F.col("at") + 2, F.size("pieces")), ""))
    rows = rows.select(key, "line", "at", F.explode(roles).alias("role"), name.alias("name")).filter("name IS NOT NULL")
    return rows.groupBy(key, "role").agg(F.min(F.struct("line", "at", "name"))["name"].alias("name"))


def engineer_credits(c: Catalogue) -> DataFrame:
    """Credits of texts that are written in six ways."""
    key, name = F.col("o_orderkey"), F.initcap(F.translate(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 6), "0123456789", "ghijklmnop"))
    who = F.concat(F.lit("Pat "), name)
    ways = [
        F.concat(F.lit("Recorded and mastered by "), who, F.lit(" using a DAT deck")),
        F.concat(F.lit("Taper: "), who, F.lit("\nTransferred by Ann Other (2001)")),
        F.concat(F.lit("taped by Schoeps MK4\ntaped by "), who, F.lit(", Paris")),
        F.concat(F.lit("Transfer / master by "), who),
        F.lit("recorded by unknown; stand by me"),
        F.concat(F.lit("Source & taper: "), who, F.lit(" > FLAC\nMastering engineer: "), who),
    ]
    text = F.element_at(F.array(*ways), (key % 6 + 1).cast("int"))
    return credits(c.table("orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text")
