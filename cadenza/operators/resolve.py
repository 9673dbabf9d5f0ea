"""Resolution of a show from several sources: date, place, kind, tracks, duplicates, personnel.

Sources of a show are its tags, its info text and its folder; each is a projection
of the show's row.  Everything is a join, a grouping or a window on the show's key, so
no group is larger than a show's own lines.  Null parts are unknown and contradict nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.checks import date_verdict, matched_checksums, track_shortfall, wholly_owned
from cadenza.sources.catalogue import Catalogue

# Weight of a less precise compatible date.
COMPATIBLE = 0.3


def date_candidates(c: Catalogue) -> DataFrame:
    """item, source (0 tags, 1 info, 2 folder), y, m, d: what each source states of a show's date."""
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    year, month, day = F.year(at), F.month(at), F.dayofmonth(at)
    tags = [F.when(key % 5 != 0, year), F.when((key % 5 != 0) & (key % 3 != 0), month), F.when((key % 5 != 0) & (key % 3 != 0) & (key % 2 == 0), day)]
    info = [year, F.when(key % 4 != 0, month), F.when(key % 4 != 0, F.when(key % 9 == 0, F.pmod(day, F.lit(28)) + 1).otherwise(day))]
    folder = [F.when(key % 6 != 0, F.when(key % 10 == 0, year + 1).otherwise(year)), F.lit(None).cast("int"), F.lit(None).cast("int")]
    sources = F.array(*(F.struct(F.lit(i).alias("source"), *(x.cast("int").alias(n) for x, n in zip(parts, "ymd"))) for i, parts in enumerate((tags, info, folder))))
    return c.table("orders").select(key.alias("item"), F.explode(sources).alias("s")).select("item", "s.*").filter("y IS NOT NULL")


def _states(a: str, b: str, parts: str = "ymd") -> list[Column]:
    return [F.col(f"{a}.{p}") != F.col(f"{b}.{p}") for p in parts]


def resolved_dates(c: Catalogue) -> DataFrame:
    """Per show: the most precise date (then tags, info, folder), its weight of sources, and whether any two contradict."""
    rows = date_candidates(c)
    precision = F.when(F.col("d").isNotNull(), 3).when(F.col("m").isNotNull(), 2).otherwise(1)
    by = Window.partitionBy("item").orderBy(F.desc(precision), "source")
    best = rows.withColumn("place", F.row_number().over(by)).filter("place = 1").select("item", "source", "y", "m", "d")
    differ = reduce(lambda x, y: x | y, [F.coalesce(x, F.lit(False)) for x in _states("a", "b")])
    pairs = best.alias("a").join(rows.alias("b"), "item")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}")) for p in "ymd"])
    weight = F.when(differ, 0.0).when(same, 1.0).otherwise(COMPATIBLE)
    scores = pairs.groupBy("item").agg(F.sum(weight).alias("score"), F.sum(differ.cast("int")).alias("rivals"))
    both = rows.alias("a").join(rows.alias("b"), (F.col("a.item") == F.col("b.item")) & (F.col("a.source") < F.col("b.source")))
    clash = both.groupBy(F.col("a.item").alias("item")).agg(F.bool_or(differ).alias("conflict"))
    out = best.join(scores, "item").join(clash, "item", "left")
    return out.select("item", "source", "y", "m", "d", F.round("score", 6).alias("score"), "rivals", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def resolved_places(c: Catalogue) -> DataFrame:
    """City and country of a show: from the source that gives the venue, else tags, else info."""
    key = F.col("id")
    rows = c.performance.select("id", "venue_id", "city").join(c.venue.select(F.col("id").alias("venue_id"), F.col("city").alias("venue_city"), "country"), "venue_id", "left")
    tags = F.when(key % 3 == 0, F.struct(F.col("venue_city").alias("city"), F.col("country").alias("country")))
    info = F.struct(F.coalesce("city", F.concat(F.lit("Town "), (key % 7).cast("string"))).alias("city"), F.lit(None).cast("string").alias("country"))
    from_venue = F.when((key % 4 == 0) & F.col("venue_id").isNotNull(), F.struct(F.col("venue_city").alias("city"), F.col("country").alias("country")))
    source = F.when(from_venue.isNotNull(), "venue").when(tags.isNotNull(), "tags").otherwise("info")
    rows = rows.select("id", source.alias("source"), F.coalesce(from_venue, tags, info).alias("p"))
    return rows.select("id", "source", "p.city", "p.country")


def show_kinds(c: Catalogue) -> DataFrame:
    """studio if an album and no month in any source and no venue; else live if there is a year; else unknown."""
    dates = date_candidates(c).groupBy("item").agg(F.count("m").alias("months"), F.count("y").alias("years"))
    album = F.col("id") % 8 == 0
    rows = c.performance.select("id", "venue_id").join(dates, F.col("id") == F.col("item"), "left")
    none = F.coalesce("months", F.lit(0)) == 0
    kind = F.when(album & none & F.col("venue_id").isNull(), "studio").when(F.coalesce("years", F.lit(0)) > 0, "live").otherwise("unknown")
    return rows.select("id", kind.alias("kind"))


def scanned_tracks(c: Catalogue) -> DataFrame:
    """show, at (scan position), printed number and tag title: a show's lines in the order of their parts."""
    by = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_suppkey", "l_shipdate")
    rows = c.table("lineitem").join(c.table("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    at = F.row_number().over(by)
    return rows.select("l_orderkey", at.alias("at"), F.col("l_linenumber").alias("printed"), F.when(F.col("l_linenumber") % 3 != 0, F.col("p_name")).alias("tag"))


def info_tracks(c: Catalogue) -> DataFrame:
    """show, number, title: what the info text lists, one less where the key is even."""
    rows = scanned_tracks(c)
    n = F.count("*").over(Window.partitionBy("l_orderkey"))
    rows = rows.withColumn("n", n).filter("l_orderkey % 2 = 1 OR at < n")
    return rows.select("l_orderkey", F.col("at").alias("number"), F.when(F.col("at") % 4 != 0, F.concat(F.lit("Song "), F.col("at").cast("string"))).alias("title"))


def aligned_tracks(c: Catalogue) -> DataFrame:
    """Titles by scan position: tag, else info (by position if the counts are equal, else by printed number), else Track n."""
    tracks, info = scanned_tracks(c), info_tracks(c)
    listed = info.groupBy("l_orderkey").agg(F.count("*").alias("listed"))
    rows = tracks.withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey"))).join(listed, "l_orderkey", "left")
    number = F.when(F.col("n") == F.col("listed"), F.col("at")).otherwise(F.coalesce("printed", "at"))
    rows = rows.withColumn("number", number).join(info, ["l_orderkey", "number"], "left")
    title = F.coalesce("tag", "title", F.concat(F.lit("Track "), F.col("at").cast("string")))
    return rows.select("l_orderkey", "at", title.alias("title"))


def disc_shortfall(c: Catalogue) -> DataFrame:
    """Shows with fewer tracks or discs than their lines say: the supplier's parity as disc, the part as total or number of discs."""
    part = F.col("l_partkey")
    rows = c.table("lineitem").select(
        "l_orderkey", (F.col("l_suppkey") % 2 + 1).alias("disc"), F.when(part % 11 > 0, F.col("l_linenumber")).alias("number"),
        F.when(part % 10 == 0, F.col("l_linenumber") + 1).alias("total"), F.when(part % 90 == 0, 3).when(part % 90 == 1, 4481).alias("discs"),
    )
    return track_shortfall(rows, "l_orderkey")


def incomplete_releases(c: Catalogue) -> DataFrame:
    """Releases that a show's set of titles is part of: of each group of editions the shortest, longer than ours, holding all our titles.

    Groups are brands, editions their sizes; groups with an edition no longer than ours are left out.
    """
    ours = c.table("lineitem").filter("l_orderkey % 50 = 0").join(c.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    ours = ours.select("l_orderkey", "p_brand", "p_name").distinct()
    n_ours = ours.groupBy("l_orderkey", "p_brand").agg(F.count("*").alias("n_ours"))
    editions = c.table("part").groupBy("p_brand", (F.col("p_size") % 3).cast("int").alias("edition")).agg(F.collect_set("p_name").alias("titles"))
    editions = editions.withColumn("n", F.size("titles"))
    least = editions.groupBy("p_brand").agg(F.min(F.struct("n", "edition")).alias("e"))
    shortest = editions.join(least.select("p_brand", F.col("e.edition").alias("edition")), ["p_brand", "edition"])
    listed = shortest.select("p_brand", "edition", "n", F.explode("titles").alias("p_name"))
    hits = ours.join(listed, ["p_brand", "p_name"]).groupBy("l_orderkey", "p_brand", "edition", "n").agg(F.count("*").alias("hits"))
    rows = hits.join(n_ours, ["l_orderkey", "p_brand"]).filter("hits = n_ours AND n > n_ours")
    return rows.select("l_orderkey", "p_brand", "edition", (F.col("n") - F.col("n_ours")).cast("int").alias("missing"))


def duplicate_shows(c: Catalogue) -> DataFrame:
    """Duplicates of four kinds: same folder (source and length), same content, content of one not published, same act and day."""
    docs = c.table("documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("digest"), (F.col("doc_id") % 3 == 0).alias("unpublished"))

    def firsts(rows: DataFrame, key: list[str], kind: str) -> DataFrame:
        first = rows.groupBy(*key).agg(F.min("id").alias("of"), F.count("*").alias("n")).filter("n > 1")
        return rows.join(first, key).filter("id <> of").select(F.lit(kind).alias("kind"), "id", "of")

    docs = docs.withColumnRenamed("doc_id", "id")
    folder = firsts(docs, ["source", "n_chars"], "folder")
    content = firsts(docs.filter("NOT unpublished"), ["digest"], "content")
    waiting = docs.filter("unpublished").join(docs.filter("NOT unpublished").groupBy("digest").agg(F.min("id").alias("of")), "digest")
    shows = firsts(c.performance.filter("d IS NOT NULL").select("id", "artist_id", "y", "m", "d"), ["artist_id", "y", "m", "d"], "same show")
    return folder.unionByName(content).unionByName(waiting.select(F.lit("unpublished").alias("kind"), "id", "of")).unionByName(shows)


def owned_wholly(c: Catalogue) -> DataFrame:
    """Shows all of whose parts have been seen at one supplier only, by lines before the last year, and no fewer than the show's lines."""
    lines = c.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("checksum"), F.col("l_suppkey").alias("owner"), F.year("l_shipdate").alias("y"))
    shows = lines.filter("l_orderkey % 10 = 0")
    counts = shows.groupBy("l_orderkey").agg(F.count_distinct("checksum", "owner").alias("n_audio"))
    return wholly_owned(shows, "l_orderkey", lines.filter("y < 1998 AND checksum % 3 > 0 OR owner % 7 = 0").select("checksum", F.lit(1).cast("long").alias("owner")).unionByName(lines.filter("owner % 50 = 1").select("checksum", "owner")), counts)


def checksum_matches(c: Catalogue) -> DataFrame:
    """Checksum entries to tracks: relative path, else unique file name, else unique stem, else position where no entry has a name and the counts are equal."""
    base = scanned_tracks(c).filter("l_orderkey % 4 = 0").select("l_orderkey", "at", F.coalesce("tag", F.concat(F.lit("t"), F.col("printed"))).alias("stem"))
    at = F.col("at")
    tracks = base.select("l_orderkey", at.alias("track"), F.concat(F.lit("d"), at % 2, F.lit("/"), F.col("stem"), F.lit(".flac")).alias("path"), "stem")
    path = F.when(F.col("l_orderkey") % 12 == 0, None).when(F.col("track") % 4 == 1, F.upper("path")).when(F.col("track") % 4 == 2, F.concat(F.lit("other/"), F.col("stem"), F.lit(".flac"))).otherwise(F.concat("stem", F.lit(".wav")))
    entries = tracks.select("l_orderkey", (F.col("track") - 1).alias("entry"), F.concat(F.lit("sum "), F.col("track")).alias("checksum"), path.alias("path"))
    # of every second text without names an entry is lost, so that its places say nothing
    entries = entries.filter("NOT (l_orderkey % 24 = 0 AND entry = 0)")
    return matched_checksums(entries, tracks.select("l_orderkey", "track", "path"), "l_orderkey")


def performance_members(c: Catalogue) -> DataFrame:
    """A show's members: the act's stints that cover it, then added people and guests; an explicit show has only those.

    A person who is named twice counts once: first as inherited, then added, then guest.
    """
    shows = c.performance.filter("id % 20 = 0").select("id", "artist_id", "y", "m", "d", (F.col("id") % 60 == 0).alias("explicit"))
    lo = F.col("y") * 10000 + F.coalesce("m", F.lit(1)) * 100 + F.coalesce("d", F.lit(1))
    hi = F.col("y") * 10000 + F.coalesce("m", F.lit(12)) * 100 + F.coalesce("d", F.lit(31))
    stints = c.membership.filter("musician_id % 3 = 0")
    inherited = shows.filter("NOT explicit").join(stints, "artist_id").filter((F.col("start_day") <= hi) & (F.col("end_day") >= lo)).select("id", "musician_id", F.lit(0).alias("how"))
    lines = c.table("lineitem").filter("l_orderkey % 20 = 0").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("musician_id"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(2).alias("how"))
    rows = inherited.unionByName(lines.join(shows.select("id"), "id", "left_semi"))
    how = F.element_at(F.array(F.lit("inherited"), F.lit("added"), F.lit("guest")), F.min("how") + 1)
    return rows.groupBy("id", "musician_id").agg(how.alias("how"))


def judgements(c: Catalogue) -> DataFrame:
    """Per kind of verdict the items: right, partial (less precise), wrong (a part that the key does not state, or otherwise), empty."""
    gold = c.performance.select(F.col("id").alias("item"), F.col("y").alias("gy"), F.col("m").alias("gm"), F.col("d").alias("gd"))
    rows = gold.join(date_candidates(c).filter("source = 0").select("item", "y", "m", "d"), "item", "left")
    verdict = date_verdict([F.col("gy"), F.col("gm"), F.col("gd")], [F.col("y"), F.col("m"), F.col("d")])
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def cross_validated(c: Catalogue, folds: int = 5) -> DataFrame:
    """Per fold a threshold on value fitted on the other folds (best accuracy, then the smallest), and its accuracy in the fold."""
    rows = c.table("events").filter("event_type IN ('purchase', 'view')")
    rows = rows.select((F.col("event_id") % folds).cast("int").alias("fold"), F.least(F.floor(F.col("value") / 5), F.lit(20)).cast("int").alias("bin"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    bins = rows.groupBy("fold", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    # right if bin >= cut and positive, or bin < cut and negative
    right = F.when(F.col("bin") >= F.col("cut"), F.col("pos")).otherwise(F.col("n") - F.col("pos"))
    cells = bins.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(20)))).groupBy("fold", "cut").agg(F.sum(right).alias("held"), F.sum("n").alias("n"))
    fit = cells.join(cells.groupBy("cut").agg(F.sum("held").alias("whole")), "cut").withColumn("inside", F.col("whole") - F.col("held"))
    best = fit.groupBy("fold").agg(F.max_by(F.struct("cut", "held", "n"), F.struct("inside", -F.col("cut"))).alias("b"))
    return best.select("fold", "b.cut", F.round(F.col("b.held") / F.col("b.n"), 9).alias("accuracy"))


def learned_aliases(c: Catalogue, most: int = 3) -> DataFrame:
    """Spellings (brand, name) to learn: unknown so far, of one artist only; names that more than ``most`` brands use are too generic."""
    seen = c.table("part").select(F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_name", "p_type").alias("alias")).groupBy("brand", "alias").agg(F.count("*").alias("times"))
    known = c.table("part").filter("p_partkey % 10 = 0").select(F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_name", "p_type").alias("alias")).distinct()
    generic = seen.groupBy("alias").agg(F.count("*").alias("brands")).filter(F.col("brands") > most)
    return seen.join(known, ["brand", "alias"], "left_anti").join(generic, "alias", "left_anti").select("brand", "alias", "times")


def technical_gates(c: Catalogue) -> DataFrame:
    """Penalties of clipping, a dead channel, opposed phase and dropouts, per recording."""
    rows = c.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_tax").alias("t"), F.max("l_discount").alias("s"), F.max("l_quantity").alias("q"))
    clip, rms, phase, drops = F.col("t"), -F.col("q") * 2, F.col("s") * 10 - 0.6, F.col("q") % 7
    penalty = F.when(clip > 0.01, F.least(F.lit(25.0), 5 + 20 * F.least(F.lit(1.0), (clip - 0.01) / 0.5))).otherwise(0.0)
    penalty += F.when(rms < -60, 30.0).otherwise(0.0) + F.when(phase < -0.3, 20.0).otherwise(0.0) + F.when(drops >= 3, 10.0).otherwise(0.0)
    return rows.select("l_orderkey", "l_linenumber", F.round(penalty, 6).alias("penalty")).filter("penalty > 0")


def rescored(c: Catalogue, version: int = 3, least: float = 0.05) -> DataFrame:
    """Recordings whose stored score (of the present feature version) changes by ``least`` or more when it is computed anew."""
    rows = c.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("p"), F.max("l_discount").alias("s"), (F.max("l_suppkey") % 5).cast("int").alias("version"))
    old, new = F.floor(F.col("p") / 100) / 10, F.col("p") / 1000 + F.col("s")
    return rows.filter(F.col("version") == version).select("l_orderkey", "l_linenumber", old.alias("old"), F.round(new, 6).alias("new")).filter(F.abs(F.col("new") - F.col("old")) >= least - 1e-9)
