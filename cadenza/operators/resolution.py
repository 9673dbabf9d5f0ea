"""Entity resolution: tiers of keys, rare n-grams, duplicates, and the reference base's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.sources.catalogue import Catalogue

# Words that do not tell acts apart.
NOISE_WORDS = ("band", "trio", "quartet", "quintet", "group", "ensemble", "orchestra", "the", "and", "with", "featuring", "feat")


def act_core(name: Column) -> Column:
    """Words of a name without noise words; all words if none is left."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ")
    core = F.filter(words, lambda w: ~w.isin(*NOISE_WORDS))
    return F.array_join(F.when(F.size(core) > 0, core).otherwise(words), " ")


def tiered_lookup(c: Catalogue) -> DataFrame:
    """Typed names to acts: exact name, else alias, else core; the smallest id of the first tier that hits.

    Acts are all parts (name, and name with type as alias); what is typed is a part's name as it is, with its
    type, or with an article and a noise word.
    """
    parts = c.table("part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("alias"))
    tiers = {"exact": F.col("name"), "alias": F.col("alias"), "core": act_core(F.col("name"))}
    typed = F.when(F.col("id") % 3 == 0, F.col("name")).when(F.col("id") % 3 == 1, F.col("alias")).otherwise(F.concat(F.lit("the "), F.col("name"), F.lit(" band")))
    rows = parts.select(F.col("id").alias("p_partkey"), typed.alias("typed")).withColumn("typed_core", act_core(F.col("typed")))
    for tier, key in tiers.items():
        first = parts.groupBy(key.alias("key")).agg(F.min("id").alias(tier))
        rows = rows.join(first, F.col("typed_core" if tier == "core" else "typed") == F.col("key"), "left").drop("key")
    hit = F.coalesce(*(F.when(F.col(t).isNotNull(), F.lit(t)) for t in tiers))
    return rows.select("p_partkey", F.coalesce(*tiers).alias("match"), hit.alias("tier"))


def grams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of a key."""
    last = F.greatest(F.length(text) - n + 1, F.lit(0))
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def gram_frequency(c: Catalogue) -> DataFrame:
    """Document frequency of the trigrams of distinct part and nation names."""
    names = c.table("part").select("p_name").union(c.table("nation").select("n_name")).distinct()
    return names.select(F.explode(grams(F.lower("p_name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))


def long_names(c: Catalogue) -> DataFrame:
    return c.table("part").select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("name")).distinct()


def fuzzy_candidates(c: Catalogue, rarest: int = 6, pool: int = 150, least: float = 0.3, gate: float = 0.85) -> DataFrame:
    """Misspelled names (the third letter lost) to names.

    A query's rarest trigrams fetch names, weighed by the sum of idf = ln(1 + n / df); the best ``pool`` go on,
    a Jaccard of all trigrams and a score (containment, else edit similarity up to .96) gate them.
    """
    names = long_names(c)
    index = names.select("name", F.explode(grams(F.col("name"))).alias("gram"))
    total = names.agg(F.count("*").alias("total"))
    freq = index.groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(total))
    freq = freq.select("gram", "df", F.log(1 + F.col("total") / F.col("df")).alias("idf"))
    typed = names.select(F.concat(F.substring("name", 1, 2), F.expr("substring(name, 4)")).alias("typed")).distinct()
    rows = typed.select("typed", F.explode(grams(F.col("typed"))).alias("gram")).join(freq, "gram")
    by = Window.partitionBy("typed").orderBy("df", "gram")
    rare = rows.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= rarest)
    met = rare.join(index, "gram").groupBy("typed", "name").agg(F.round(F.sum("idf"), 9).alias("weight"))
    best = Window.partitionBy("typed").orderBy(F.desc("weight"), "name")
    met = met.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= pool)
    ga, gb = grams(F.col("typed")), grams(F.col("name"))
    jaccard = F.size(F.array_intersect(ga, gb)) / F.size(F.array_union(ga, gb))
    longer, shorter = F.greatest(F.length("typed"), F.length("name")), F.least(F.length("typed"), F.length("name"))
    inside = (shorter >= 5) & (F.contains(F.col("name"), F.col("typed")) | F.contains(F.col("typed"), F.col("name")))
    score = F.when(F.col("typed") == F.col("name"), 0.97).when(inside, F.least(F.lit(0.95), 0.6 + 0.4 * shorter / longer)).otherwise(F.least(F.lit(0.96), 1 - F.levenshtein("typed", "name") / longer))
    rows = met.select("typed", "name", F.round(jaccard, 9).alias("jaccard"), F.round(score, 9).alias("score"))
    return rows.filter((F.col("jaccard") >= least) & (F.col("score") >= gate))


def similar_names(c: Catalogue, percent: int = 85) -> DataFrame:
    """All pairs of names with an edit similarity of ``percent`` or more, wherever they differ.

    A name of L letters is cut into one piece more than the edits that the similarity allows, so a similar name
    holds one of the pieces unchanged, shifted by the edits at most.  Names meet by (L, piece number, piece) only.
    """
    names = long_names(c)
    most = lambda n: F.floor((100 - percent) * n / percent).cast("int")  # noqa: E731  edits allowed against any name similar to one of n letters
    cut = names.select("name", F.length("name").alias("n")).filter("n > 0").withColumn("k", most(F.col("n")))
    start = "cast(floor(n * i / (k + 1)) AS int)"
    size = f"cast(floor(n * (i + 1) / (k + 1)) AS int) - {start}"
    pieces = cut.withColumn("i", F.explode(F.expr("sequence(0, k)"))).select("name", "n", "i", F.expr(f"substring(name, {start} + 1, {size})").alias("piece"))
    probes = cut.select(F.col("name").alias("other"), F.col("n").alias("own"))
    probes = probes.withColumn("n", F.explode(F.expr(f"sequence(cast(ceil(own * {percent} / 100.0) AS int), cast(floor(own * 100.0 / {percent}) AS int))"))).filter("n > 0")
    probes = probes.withColumn("k", most(F.col("n"))).withColumn("i", F.explode(F.expr("sequence(0, k)"))).withColumn("shift", F.explode(F.expr("sequence(-k, k)")))
    probes = probes.filter(f"{start} + shift >= 0").select("other", "n", "i", F.expr(f"substring(other, {start} + 1 + shift, {size})").alias("piece"))
    pairs = pieces.join(probes.distinct(), ["n", "i", "piece"]).filter("name <> other")
    pairs = pairs.select(F.least("name", "other").alias("x"), F.greatest("name", "other").alias("y")).distinct()
    longer = F.greatest(F.length("x"), F.length("y"))
    distance = F.levenshtein("x", "y")
    return pairs.filter(100 * distance <= (100 - percent) * longer).select("x", "y", F.round(1 - distance / longer, 9).alias("ratio"))


def content_duplicates(c: Catalogue) -> DataFrame:
    """Documents whose whole text an earlier one has: the first owner of each digest."""
    rows = c.table("documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies")).filter("copies > 1")
    return rows.join(first, "digest").filter("doc_id <> owner").select("doc_id", "owner", "copies")


def sole_owner(c: Catalogue) -> DataFrame:
    """Orders all of whose lines are of one supplier, two lines at least."""
    rows = c.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("owners"), F.min("l_suppkey").alias("owner"))
    return rows.filter("owners = 1 AND n >= 2").select("l_orderkey", "n", "owner")


def stable_sample(c: Catalogue, n: int = 25) -> DataFrame:
    """The n names with the smallest SHA-1 (a sampling operator)."""
    return c.table("customer").select("c_custkey", F.sha1(F.col("c_name").cast("binary")).alias("h")).orderBy("h", "c_custkey").limit(n)


def dominant_place(c: Catalogue, ratio: float = 1.2) -> DataFrame:
    """A nation's leading segment by balance if it leads the next by the ratio, else null."""
    rows = c.table("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    by = Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "c_mktsegment")
    rows = rows.withColumn("place", F.row_number().over(by)).filter("place <= 2")
    rows = rows.groupBy("c_nationkey").agg(F.max(F.when(F.col("place") == 1, F.col("c_mktsegment"))).alias("top"), F.max(F.when(F.col("place") == 1, F.col("n"))).alias("n1"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("n"))), F.lit(0)).alias("n2"))
    return rows.select("c_nationkey", F.when(F.col("n1") >= ratio * F.col("n2"), F.col("top")).alias("place"))


def capped_aliases(c: Catalogue, cap: int = 3) -> DataFrame:
    """Distinct normalised names per brand, the first of each key, capped in order."""
    rows = c.table("part").select("p_brand", "p_partkey", act_core(F.col("p_name")).alias("key"))
    rows = rows.groupBy("p_brand", "key").agg(F.min("p_partkey").alias("first"))
    by = Window.partitionBy("p_brand").orderBy("first")
    return rows.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= cap).select("p_brand", "key", "first", "place")


def popularity(c: Catalogue) -> DataFrame:
    """Acts with shows or members: three a show and one a member."""
    shows = c.performance.groupBy("artist_id").agg(F.count("*").alias("shows"))
    members = c.membership.groupBy("artist_id").agg(F.count("*").alias("members"))
    rows = shows.join(members, "artist_id", "full")
    return rows.select("artist_id", (3 * F.coalesce("shows", F.lit(0)) + F.coalesce("members", F.lit(0))).alias("popularity"))


def area_chain(c: Catalogue, depth: int = 10) -> DataFrame:
    """Ancestors of each part number in a tree of halves, at most ``depth`` steps, cycles cut."""
    area = c.table("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"))
    return ancestors(area, depth)


def ancestors(area: DataFrame, depth: int) -> DataFrame:
    """id, n_above, top: how many steps up from each id of ``area`` (id, parent), ``depth`` at most, and the least id reached.

    A join a step with one row an id, so that chains of any number fit; of repeated ids every way up counts.
    """
    area = area.filter("parent IS NOT NULL").groupBy("id", "parent").agg(F.count("*").alias("ways"))
    up = area.select(F.col("id").alias("at"), F.col("parent").alias("next"), F.col("ways").alias("more"))
    rows = area.select("id", F.col("parent").alias("at"), "ways", F.col("ways").alias("n_above"), F.col("parent").alias("top"))
    for _ in range(depth - 1):
        ways = F.coalesce(F.col("ways") * F.col("more"), F.lit(0))
        rows = rows.join(up, "at", "left").select("id", F.col("next").alias("at"), ways.alias("ways"), (F.col("n_above") + ways).alias("n_above"), F.least("top", "next").alias("top"))
    return rows.groupBy("id").agg(F.sum("n_above").alias("n_above"), F.min("top").alias("top"))
