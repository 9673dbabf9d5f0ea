"""Ranked search: a long table of keys, one graded score per term, all terms must match."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.normalise import search_key
from cadenza.sources.catalogue import Catalogue

# Grades of a match.
EXACT, PREFIX, WORD_START, INFIX = 100, 80, 60, 40


def norm(x: Column) -> Column:
    """Lower case without accents, apostrophes gone, other punctuation to single spaces."""
    return search_key(x)


def grade(key: Column, term: str) -> Column:
    t = F.lit(term)
    return F.when(key == t, EXACT).when(key.startswith(t), PREFIX).when(F.contains(key, F.lit(" " + term)), WORD_START).when(F.contains(key, t), INFIX).otherwise(0)


def search_keys(c: Catalogue) -> DataFrame:
    """grp, id, key: what can be matched."""
    acts = c.artist.select(F.lit("artists").alias("grp"), "id", F.explode(F.array("name", "sort_name")).alias("key"))
    venues = c.venue.select(F.lit("venues").alias("grp"), "id", F.explode(F.array("name", "city", "state", "country")).alias("key"))
    albums = c.table("part").select(F.lit("albums").alias("grp"), F.col("p_partkey").alias("id"), F.explode(F.array("p_name", "p_brand")).alias("key"))
    return acts.unionByName(venues).unionByName(albums).filter("key IS NOT NULL").select("grp", "id", norm(F.col("key")).alias("key"))


def search(c: Catalogue, terms: tuple[str, ...]) -> DataFrame:
    """Rows that match every term: the mean of the terms' best grades."""
    best = [F.max(grade(F.col("key"), t)).alias(f"t{i}") for i, t in enumerate(terms)]
    rows = search_keys(c).groupBy("grp", "id").agg(*best)
    names = [F.col(f"t{i}") for i in range(len(terms))]
    return rows.filter(reduce(lambda a, b: a & b, [n > 0 for n in names])).select("grp", "id", (reduce(lambda a, b: a + b, names) / len(terms)).alias("score"))


def search_dated(c: Catalogue, year: int, month: int | None = None) -> DataFrame:
    """Recordings whose show's date has the typed parts; unknown years match nothing."""
    rows = c.performance.filter(F.col("y") == year)
    rows = rows.filter(F.col("m") == month) if month else rows
    return rows.select(F.col("id").alias("performance_id"), "y", "m").join(c.recording.select("id", "performance_id", "quality"), "performance_id").select("id", "y", "m", "quality")


#: Two-digit years up to this one are of this century.
PIVOT = 26


def parse_query(q: str) -> tuple[list[str], list[tuple[int, int | None, int | None]]]:
    """Text terms and date terms (year, month, day) of what was typed; dates are looked for first."""
    terms, dates = [], []
    for token in q.lower().split():
        if m := re.fullmatch(r"((?:19|20)\d\d)(?:-(\d\d?)(?:-(\d\d?))?)?", token):
            dates.append((int(m[1]), int(m[2]) if m[2] else None, int(m[3]) if m[3] else None))
        elif m := re.fullmatch(r"(\d\d?)/(\d\d?)/(\d\d(?:\d\d)?)", token):
            year = int(m[3])
            dates.append((year if year > 99 else year + (2000 if year <= PIVOT else 1900), int(m[1]), int(m[2])))
        else:
            terms += re.sub(r"[^\w]+", " ", re.sub("['’]", "", token)).split()
    return terms, dates


def search_all(c: Catalogue, q: str, limit: int = 20) -> DataFrame:
    """grp, id, score, place: the best ``limit`` rows of each group for text and dates together (a top-k report).

    Entities match on text only and are left out if none is typed; recordings must match every term and every
    date on the keys of their act, venue and place.  Order: score, first key, id; a typed date part must be known.
    """
    terms, dates = parse_query(q)
    library = c.recording.filter("location = 'library'").select("id", F.col("performance_id").alias("show"))
    shows = c.performance.select(F.col("id").alias("show"), "artist_id", "venue_id", "y", "m", "d", F.col("city").alias("own_city"))
    for y, m, d in dates:
        shows = shows.filter(reduce(lambda a, b: a & b, [F.col(k) == x for k, x in (("y", y), ("m", m), ("d", d)) if x is not None]))
    # keys are graded once for each act, venue and own city, and not for each recording
    acts = c.artist.select(F.col("id").alias("artist_id"), *_best(["name", "sort_name"], terms, "act_"))
    venues = c.venue.select(F.col("id").alias("venue_id"), F.col("city").isNotNull().alias("has_city"), *_best(["city", "state", "country", "name"], terms, "venue_"))
    found = library.join(shows, "show").join(acts, "artist_id").join(venues, "venue_id", "left")
    for i, t in enumerate(terms):
        # an own city is one of few, or none: graded only where no venue has one
        own = F.when(F.col("has_city"), 0).otherwise(F.coalesce(grade(norm(F.col("own_city")), t), F.lit(0)))
        found = found.withColumn(f"t{i}", F.greatest(f"act_t{i}", F.coalesce(f"venue_t{i}", F.lit(0)), own))
    scores = [F.col(f"t{i}") for i in range(len(terms))]
    every = reduce(lambda a, b: a & b, [s > 0 for s in scores], F.lit(True))
    score = (reduce(lambda a, b: a + b, scores, F.lit(0)) / max(len(terms), 1)).alias("score")
    groups = {"recordings": found.withColumn("first_key", F.col("act_key"))}
    if terms:
        for grp, rows, key, names in (("artists", c.artist, "id", ["name", "sort_name"]), ("venues", c.venue, "id", ["name", "city", "state", "country"]), ("albums", c.table("part"), "p_partkey", ["p_name", "p_brand"])):
            groups[grp] = rows.select(F.col(key).alias("id"), *_best(names, terms, "")).withColumnRenamed("key", "first_key")
    order = [F.desc("score"), "first_key", "id"]
    # the best of a group are kept as its rows are read; no group is sorted whole
    out = [rows.filter(every).select(F.lit(grp).alias("grp"), "id", "first_key", score).orderBy(*order).limit(limit) for grp, rows in groups.items()]
    return reduce(DataFrame.unionByName, out).withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).select("grp", "id", "score", "place")


def _best(names: list[str], terms: list[str], prefix: str) -> list[Column]:
    """key (the first name's) and t0, t1, ...: each term's best grade among the names, 0 if there is none."""
    best = [F.greatest(F.lit(0), *(F.coalesce(grade(norm(F.col(n)), t), F.lit(0)) for n in names)) for t in terms]
    return [norm(F.col(names[0])).alias(f"{prefix}key"), *(b.alias(f"{prefix}t{i}") for i, b in enumerate(best))]


def _graded(keys: DataFrame, by: list[str], terms: list[str]) -> DataFrame:
    """by, first (the key with the least place), t0, t1, ...: the best grade of each term among the keys (by, place, key) of one thing."""
    rows = keys.withColumn("key", norm(F.col("key"))).filter("key <> ''")
    return rows.groupBy(*by).agg(F.min(F.struct("place", "key"))["key"].alias("first"), *(F.max(grade(F.col("key"), t)).alias(f"t{i}") for i, t in enumerate(terms)))


def ranked_search(entities: DataFrame, acts: DataFrame, venues: DataFrame, recordings: DataFrame, typed: str, limit: int = 20) -> DataFrame:
    """grp, id, score, place, total: the best ``limit`` of each group and how many match (a top-k report).

    ``entities`` has the keys (grp, id, place, key) of all things that have names.  A recording is found by the keys of its act, the
    act's members among them (``acts``: artist_id, place, key), and of its venue (``venues``: venue_id, place, key); these are graded
    once for each act and venue, and not for each recording.  ``recordings``: id, artist_id, venue_id, quality, y, m, d.

    Every text term has to match, and on recordings every date, which counts as exact; the score is the mean.  Entities match
    text alone, and are left out if none is typed.  Entities go by score, first key and id; recordings by score, quality and date.
    """
    terms, dates = parse_query(typed)
    names = [f"t{i}" for i in range(len(terms))]
    if not terms and not dates:
        return entities.limit(0).select("grp", "id", F.lit(0.0).alias("score"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("total"))
    found = recordings.filter(reduce(lambda a, b: a & b, [F.col(k) == x for date in dates for k, x in zip("ymd", date) if x is not None], F.lit(True)))
    if terms:
        sides = [_graded(keys, [by], terms).select(by, *(F.col(t).alias(f"{by}_{t}") for t in names)) for keys, by in ((acts, "artist_id"), (venues, "venue_id"))]
        found = found.join(sides[0], "artist_id", "left").join(sides[1], "venue_id", "left")
        found = found.select("id", "quality", "y", "m", "d", *(F.greatest(F.lit(0), F.coalesce(f"artist_id_{t}", F.lit(0)), F.coalesce(f"venue_id_{t}", F.lit(0))).alias(t) for t in names))
    every = reduce(lambda a, b: a & b, [F.col(t) > 0 for t in names], F.lit(True))
    total = reduce(lambda a, b: a + b, [F.col(t) for t in names], F.lit(0))
    rank = [-F.coalesce("quality", F.lit(-1.0)), *(-F.coalesce(p, F.lit(0)) for p in "ymd")]
    found = found.filter(every).select(F.lit("recordings").alias("grp"), "id", ((total + EXACT * len(dates)) / (len(terms) + len(dates))).alias("score"), F.lit("").alias("first"), F.array(*(r.cast("double") for r in rank)).alias("rank"))
    if terms:
        others = _graded(entities, ["grp", "id"], terms).filter(every)
        found = found.unionByName(others.select("grp", "id", (total / len(terms)).alias("score"), "first", F.lit(None).cast("array<double>").alias("rank")))
    by = Window.partitionBy("grp").orderBy(F.desc("score"), "first", "rank", "id")
    best = found.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= limit)
    return best.join(found.groupBy("grp").agg(F.count("*").alias("total")), "grp").select("grp", "id", "score", "place", "total")


def _keys(rows: DataFrame, columns: list[str], *of: Column | str) -> DataFrame:
    """of, place, key: the columns of a row as keys, in their order."""
    return rows.select(*of, F.posexplode(F.array(*columns)).alias("place", "key")).filter("key IS NOT NULL")


def search_people(c: Catalogue, typed: str) -> DataFrame:
    """The whole search, members of acts, musicians, albums and engineers with their aliases among its keys."""
    letters = F.translate(F.col("s_suppkey").cast("string"), "0123456789", "abcdefghij")
    musicians = c.table("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Player "), letters).alias("name"))
    members = c.membership.join(musicians, F.col("musician_id") == F.col("id")).select("artist_id", F.lit(2).alias("place"), F.col("name").alias("key"))
    engineers = c.table("nation").select(F.col("n_nationkey").alias("id"), "n_name", F.concat(F.lit("Play-"), F.col("n_name")).alias("alias"))
    albums = c.recording.filter("kind = 'studio'").join(c.performance.select(F.col("id").alias("performance_id"), "artist_id"), "performance_id")
    albums = albums.join(c.artist.select(F.col("id").alias("artist_id"), "name", "sort_name"), "artist_id").select("id", F.concat(F.lit("Record "), F.col("performance_id")).alias("title"), "name", "sort_name")
    own, halls = _keys(c.artist, ["name", "sort_name"], F.col("id").cast("long").alias("id")), _keys(c.venue, ["name", "city", "state", "country"], "id")
    entities = [("artists", own), ("venues", halls), ("musicians", _keys(musicians, ["name"], "id")), ("albums", _keys(albums, ["title", "name", "sort_name"], "id")), ("engineers", _keys(engineers, ["n_name", "alias"], F.col("id").cast("long").alias("id")))]
    entities = reduce(DataFrame.unionByName, [k.withColumn("grp", F.lit(g)) for g, k in entities])
    shows = c.performance.select(F.col("id").alias("performance_id"), "artist_id", "venue_id", "y", "m", "d")
    quality = F.when(F.col("quality") == "A", 90.0).when(F.col("quality") == "B", 70.0)
    recordings = c.recording.filter("kind = 'live'").select("id", "performance_id", quality.alias("quality")).join(shows, "performance_id")
    acts = own.withColumnRenamed("id", "artist_id").unionByName(members)
    return ranked_search(entities, acts, halls.withColumnRenamed("id", "venue_id"), recordings, typed)
