"""Checks of shows against what they say of themselves: verdicts, missing tracks, checksums, owners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.normalise import name_key
from cadenza.sources.catalogue import Catalogue

# The largest disc number that is one, endings of an act's name that make a variant of it, endings of sound.
MOST_DISCS = 50
ENSEMBLES = "trio quartet quintet sextet septet octet band group orchestra".split()
SOUND = "flac wav shn mp3".split()


# --- verdicts


def date_verdict(gold: list[Column], said: list[Column]) -> Column:
    """right, partial (less precise), wrong (a stated part that the key does not state, or states otherwise), empty; null without a key."""
    known = lambda c: F.nullif(c, F.lit(0))
    gold, said = [known(c) for c in gold], [known(c) for c in said]
    same = reduce(lambda a, b: a & b, (g.eqNullSafe(s) for g, s in zip(gold, said)))
    contradicts = reduce(lambda a, b: a | b, (s.isNotNull() & ~g.eqNullSafe(s) for g, s in zip(gold, said)))
    return F.when(gold[0].isNull(), None).when(said[0].isNull(), "empty").when(same, "right").when(contradicts, "wrong").otherwise("partial")


def name_verdict(gold: Column, said: Column, act: bool = False) -> Column:
    """right, variant (of an act: one ensemble by another name), partial (one within the other, by whole words), wrong or empty; null without a key."""
    gold, said = (F.coalesce(name_key(c), F.lit("")) for c in (gold, said))
    within = lambda a, b: F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))
    tail = rf"(\s+({'|'.join(ENSEMBLES)}))+$|\s+and\s+friends$|\s+and\s+(his|her)\s+.+$|\s+with\s+.+$"
    base = lambda c: F.trim(F.regexp_replace(c, tail, ""))
    variant = (base(gold) == base(said)) & (base(gold) != "") if act else F.lit(False)
    return F.when(gold == "", None).when(said == "", "empty").when(gold == said, "right").when(variant, "variant").when(within(gold, said) | within(said, gold), "partial").otherwise("wrong")


# --- missing tracks


def track_shortfall(tracks: DataFrame, key: str) -> DataFrame:
    """key, have, expected, unit (discs or tracks): the shows that lack something by their own tags.

    ``tracks`` has disc, number, total and discs (what the tags say; each may be null).  First the discs: fewer than
    the tags count or number, up to 50.  Then numbers that never repeat over several discs are one sequence, whose
    total is the show's.  Else disc by disc: its total, or its highest number; numbers that go on exactly where the
    files of the discs before end are counted from there.
    """
    disc, discs = F.when(F.col("disc") <= MOST_DISCS, F.col("disc")), F.when(F.col("discs") <= MOST_DISCS, F.col("discs"))
    rows = tracks.select(key, F.coalesce(disc, F.lit(1)).alias("disc"), disc.alias("tag"), discs.alias("discs"), "total", F.when(F.col("number") > 0, F.col("number")).alias("number"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    each = rows.groupBy(key, "disc").agg(
        F.count("*").alias("n"), zero(F.max("total")).alias("total"), F.min("number").alias("lo"), F.max("number").alias("hi"), F.count_distinct("number").alias("numbers"),
        F.greatest(zero(F.max("discs")), zero(F.max("tag"))).alias("said"),
    )
    before = zero(F.sum("n").over(Window.partitionBy(key).orderBy("disc").rowsBetween(Window.unboundedPreceding, -1)))
    goes_on = (before > 0) & (F.col("lo") == before + 1)
    most = F.when(goes_on, F.col("hi") - F.col("lo") + 1).otherwise(F.col("hi"))
    each = each.withColumn("expected", F.greatest("total", zero(most), "n"))
    # numbers of all discs, each once: as many as the discs have together, if none repeats
    apart = rows.groupBy(key).agg(F.count_distinct("number").alias("different"))
    show = each.groupBy(key).agg(
        F.count("*").alias("present"), F.max("said").alias("said"), F.sum("n").alias("have"), F.sum("expected").alias("by_disc"), F.sum("numbers").alias("numbers"),
        F.greatest(F.max("total"), zero(F.max("hi")), F.sum("n")).alias("as_one"),
    ).join(apart, key)
    lacks_discs = F.col("said") > F.col("present")
    sequence = (F.col("present") > 1) & (F.col("numbers") > 0) & (F.col("numbers") == F.col("different"))
    have = F.when(lacks_discs, F.col("present")).otherwise(F.col("have"))
    expected = F.when(lacks_discs, F.col("said")).when(sequence, F.col("as_one")).otherwise(F.col("by_disc"))
    out = show.select(key, have.cast("long").alias("have"), expected.cast("long").alias("expected"), F.when(lacks_discs, "discs").otherwise("tracks").alias("unit"))
    return out.filter("expected > have")


# --- checksums


def checksum_entries(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, entry (from 0), checksum, path: the lines of checksum files that hold a sum of 32 hexadecimal digits.

    What else the line says is the path, without signs around it and tools' marks in brackets before it, if it ends like sound.
    """
    rows = texts.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line", "said"))
    checksum = F.regexp_extract("said", r"\b([0-9a-fA-F]{32})\b", 1)
    rows = rows.withColumn("checksum", F.lower(checksum)).filter("checksum <> ''")
    edges = lambda c: F.regexp_replace(c, r"^[ \t*:]+|[ \t*:]+$", "")
    rest = edges(F.regexp_replace("said", r"\b[0-9a-fA-F]{32}\b", " "))
    rest = edges(F.regexp_replace(rest, r"^(\s*\[[^\]]*\]\s*)+", ""))
    path = F.regexp_replace(F.translate(rest, "\\", "/"), "^/+|/+$", "")
    path = F.when(rest.rlike(rf"(?i)\.({'|'.join(SOUND)})$"), path)
    entry = F.row_number().over(Window.partitionBy(key).orderBy("line")) - 1
    return rows.select(key, entry.alias("entry"), "checksum", path.alias("path"))


def _last(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def matched_checksums(entries: DataFrame, tracks: DataFrame, key: str) -> DataFrame:
    """key, track, checksum, tier: the tracks (key, track, path) whose checksum is known for sure.

    By path, else by a file name or, last, a stem that only one track of the show has; case does not
    count.  Of entries that mean one track the first counts.  Where no entry has a name, and only if there are
    as many as tracks, they go by position.
    """
    low = lambda c: F.lower(c)
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    plain = low(F.regexp_replace(F.translate("path", "\\", "/"), "^/+|/+$", ""))
    # entries and tracks are rows of one table, dealt by their show alone: one shuffle for all tiers
    said = entries.select(key, "entry", "checksum", plain.alias("path"), F.lit(None).cast(tracks.schema["track"].dataType).alias("of"))
    have = tracks.select(key, F.lit(None).cast(entries.schema["entry"].dataType).alias("entry"), F.lit(None).cast("string").alias("checksum"), plain.alias("path"), F.col("track").alias("of"))
    rows = said.withColumn("is_track", F.lit(False)).unionByName(have.withColumn("is_track", F.lit(True))).filter(F.col(key).isNotNull())
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    rows = rows.withColumn("name", _last(F.col("path"))).withColumn("stem", stem(F.col("name")))
    is_track = F.col("is_track")
    show = Window.partitionBy(key)
    counts = {"tracks": F.count_if(is_track), "entries": F.count_if(~is_track), "named": F.count(F.when(~is_track, F.col("path")))}
    rows = rows.withColumn("place", F.when(is_track, F.row_number().over(Window.partitionBy(key, "is_track").orderBy("of")) - 1).otherwise(F.col("entry")))
    rows = rows.select("*", *(n.over(show).alias(c) for c, n in counts.items())).filter("tracks > 0 AND entries > 0")
    # a path with its folders is one track's; of tracks with one path the last counts, of names only those that are one track's
    for c in ("path", "name", "stem"):
        same = Window.partitionBy(key, c)
        one = F.col(c).isNotNull() if c == "path" else F.col(c).isNotNull() & (F.count_if(is_track).over(same) == 1)
        rows = rows.withColumn(f"by_{c}", F.when(one, F.max("of").over(same)))
    rows = rows.withColumn("by_position", F.max("of").over(Window.partitionBy(key, "place"))).filter(~is_track)
    position = F.when((F.col("named") == 0) & (F.col("entries") == F.col("tracks")), F.col("by_position"))
    tiers = {"path": F.col("by_path"), "name": F.col("by_name"), "stem": F.col("by_stem"), "position": position}
    rows = rows.withColumn("track", F.coalesce(*tiers.values())).withColumn("tier", F.coalesce(*(F.when(c.isNotNull(), t) for t, c in tiers.items())))
    first = rows.filter("track IS NOT NULL").groupBy(key, "track").agg(F.min(F.struct("entry", "checksum", "tier")).alias("x"))
    return first.select(key, "track", "x.checksum", "x.tier")


def wholly_owned(shows: DataFrame, key: str, owned: DataFrame, n_audio: DataFrame) -> DataFrame:
    """key, owner, n_hash: the shows all of whose checksums (key, checksum) are known and of one owner (checksum, owner), no fewer than their audio files (key, n_audio)."""
    asked = shows.select(key, "checksum").distinct()
    found = asked.join(owned.distinct(), "checksum", "left")
    rows = found.groupBy(key).agg(
        F.count_distinct("checksum").alias("n_hash"), F.count_if(F.col("owner").isNull()).alias("unknown"), F.min("owner").alias("owner"), F.max("owner").alias("other")
    )
    rows = rows.join(n_audio, key).filter("unknown = 0 AND owner = other AND n_hash >= n_audio")
    return rows.select(key, "owner", "n_hash")


# --- quantiles


def indexed_quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float], splits: int = 100) -> DataFrame:
    """group, median, the value at place floor(n * share) of each share, most and mean; null values do not count.

    Values are counted, and dealt into ranges by approximate quantiles of their group, so that a group is ranked
    range by range; only ranges that hold an asked place are looked into.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("k"))
    cuts = counted.groupBy(group).agg(F.percentile_approx("v", [i / splits for i in range(1, splits)], 1000).alias("cuts"), F.sum("k").alias("n"), F.max("v").alias("most"), (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"))
    counted = counted.join(cuts.select(group, "cuts"), group).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    ranges = counted.groupBy(group, "range").agg(F.sum("k").alias("in_range"))
    ranges = ranges.withColumn("upto", F.sum("in_range").over(Window.partitionBy(group).orderBy("range")))
    n = F.col("n")
    places = {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2)} | {name: F.least(n - 1, F.floor(n * F.lit(share))) for name, share in shares.items()}
    asked = cuts.select(group, F.explode(F.array(*(F.struct(F.lit(name).alias("name"), p.cast("long").alias("place")) for name, p in places.items()))).alias("a")).select(group, "a.*")
    asked = asked.join(ranges, group).filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("in_range")))
    asked = asked.select(group, "name", "range", (F.col("place") - F.col("upto") + F.col("in_range")).alias("at"))
    inside = counted.join(asked.select(group, "range").distinct(), [group, "range"], "left_semi")
    inside = inside.withColumn("seen", F.sum("k").over(Window.partitionBy(group, "range").orderBy("v")))
    found = asked.join(inside, [group, "range"]).filter((F.col("at") < F.col("seen")) & (F.col("at") >= F.col("seen") - F.col("k")))
    found = found.groupBy(group).pivot("name", list(places)).agg(F.max("v"))
    return found.join(cuts, group).select(group, ((F.col("low") + F.col("high")) / 2).alias("median"), *shares, "most", "mean")


# --- queries


def named_acts(c: Catalogue) -> DataFrame:
    """Verdicts on the names of acts that are written in six ways."""
    key, name = F.col("c_custkey"), F.translate("c_name", "#", " ")
    ways = [name, F.upper(name), F.concat(name, F.lit(" Quartet")), F.concat(F.lit("Early "), name), F.lit("Nobody"), F.lit(None).cast("string")]
    said = F.element_at(F.array(*ways), (key % 6 + 1).cast("int"))
    return c.table("customer").groupBy(name_verdict(name, said, act=True).alias("verdict")).agg(F.count("*").alias("n"))


def checksum_files(c: Catalogue) -> DataFrame:
    """Checksums of each order's lines, written as files of four kinds, matched back to the lines."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    lines = c.table("lineitem").select("l_orderkey", "l_linenumber").distinct()
    name = F.concat(F.lit("Track "), line, F.lit(".flac"))
    tracks = lines.select("l_orderkey", line.alias("track"), F.concat(F.lit("cd"), line % 2, F.lit("/"), name).alias("path"))
    digest = F.md5(F.concat_ws("-", key, line))
    entry = F.when(key % 4 == 0, F.concat(digest, F.lit(" *cd"), line % 2, F.lit("\\"), name)).when(key % 4 == 1, F.concat(F.upper(digest), F.lit("  [shntool]  Track "), line, F.lit(".SHN")))
    entry = entry.when(key % 4 == 2, digest).otherwise(F.concat(F.lit("Track "), line, F.lit(".flac:"), digest))
    texts = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", entry.alias("e")))), lambda x: x["e"]), "\r\n").alias("t"))
    texts = texts.select("l_orderkey", F.concat(F.lit("; made by hand\n\n"), F.col("t")).alias("t"))
    # of every fifth file without names a line is lost
    texts = texts.withColumn("t", F.when(F.col("l_orderkey") % 20 == 2, F.regexp_replace("t", r"\r?\n[^\n]*$", "")).otherwise(F.col("t")))
    return matched_checksums(checksum_entries(texts, "l_orderkey", "t"), tracks, "l_orderkey")
