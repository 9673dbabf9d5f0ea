"""Orders inside a group, choices by score and margin, names without collisions.

Windows are partitioned; what can be an aggregate (first, best, span) is one, so that
it is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.sources.catalogue import Catalogue

STATUSES = ("F", "O", "P", "X")
#: Thresholds and margins that the grid search tries, and the share of wrong answers it allows.
TAUS, MARGINS, MOST_WRONG = (20, 40, 60), (0, 5, 10), 0.3


def round_robin(c: Catalogue, seed: str = "2024-01-01:0") -> DataFrame:
    """Published recordings in rounds, one of each act a round, in an order set by the seed."""
    rows = c.recording.filter("location = 'library'").select("id", F.col("performance_id").alias("show"))
    rows = rows.join(c.performance.select(F.col("id").alias("show"), "artist_id"), "show")
    order = Window.partitionBy("artist_id").orderBy(F.sha1(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))), "id")
    return rows.select("id", "artist_id", F.row_number().over(order).alias("round"))


def lead_first(c: Catalogue) -> DataFrame:
    """Shows to work on: the first of each act without members leads, the rest follow."""
    known = c.membership.select("artist_id").distinct()
    lead = c.performance.join(known, "artist_id", "left_anti").groupBy("artist_id").agg(F.min("id").alias("lead"))
    rows = c.performance.select("id", "artist_id").join(lead, "artist_id", "left")
    return rows.select("id", F.when(F.col("id") == F.col("lead"), 0).otherwise(1).alias("lane"))


def queue_order(c: Catalogue) -> DataFrame:
    """Size of the queue that each order waits in, and its place there; smaller queues go first."""
    queue = Window.partitionBy("o_custkey")
    return c.table("orders").select(
        "o_orderkey", F.count("*").over(queue).alias("queue"), F.row_number().over(queue.orderBy("o_orderdate", "o_orderkey")).alias("place")
    )


def collision_names(c: Catalogue) -> DataFrame:
    """Names made unique whatever their case: the second becomes 'name (2)'."""
    place = F.row_number().over(Window.partitionBy(F.lower("p_name")).orderBy("p_partkey"))
    rows = c.table("part").select("p_partkey", "p_name", place.alias("place"))
    return rows.select("p_partkey", F.when(F.col("place") == 1, F.col("p_name")).otherwise(F.format_string("%s (%d)", "p_name", "place")).alias("name"))


def natural_keys(c: Catalogue) -> DataFrame:
    """Sort keys in which runs of digits compare as numbers."""
    name = F.lower(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")))
    padded = F.regexp_replace(F.regexp_replace(name, "([0-9]+)", "00000000$1"), "[0-9]*([0-9]{8})", "$1")
    return c.table("part").select("p_partkey", padded.alias("sort_key"))


def release_choice(c: Catalogue, least: float = 200_000.0, margin: float = 10_000.0) -> DataFrame:
    """Per act the group of editions with the best score, accepted by gate and margin; of its editions the earliest."""
    groups = c.table("orders").groupBy("o_custkey", "o_orderpriority").agg(
        F.max("o_totalprice").alias("score"), F.min(F.struct("o_orderdate", "o_orderkey")).alias("first")
    )
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("score"), "o_orderpriority"))
    best = groups.withColumn("place", place).filter("place <= 2").groupBy("o_custkey")
    best = best.agg(
        F.max_by("o_orderpriority", F.when(F.col("place") == 1, 1)).alias("grp"),
        F.max(F.when(F.col("place") == 1, F.col("first.o_orderkey"))).alias("edition"),
        F.max("score").alias("score"),
        F.max(F.when(F.col("place") == 2, F.col("score"))).alias("next"),
    )
    good = (F.col("score") >= least) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= margin)
    return best.select("o_custkey", "grp", "edition", good.alias("accepted"))


def date_spans(c: Catalogue) -> DataFrame:
    """First and last partial date of each venue's shows; a missing part counts as 0."""
    date = F.struct("y", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("d", F.lit(0)).alias("d"))
    spans = c.performance.filter("venue_id IS NOT NULL").groupBy("venue_id").agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return spans.select("venue_id", *(F.col(f"{s}.{p}").alias(f"{n}_{p}") for s, n in (("a", "first"), ("b", "last")) for p in "ymd"))


def status_buckets(c: Catalogue) -> DataFrame:
    """Orders by status, each known status once, 0 where there are none."""
    one = c.table("orders").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(s) for s in STATUSES))
    pairs = F.array(*(F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in STATUSES))
    return one.select(F.explode(pairs).alias("p")).select("p.status", "p.n")


def grid_search(c: Catalogue) -> DataFrame:
    """The (tau, margin) with most confident rows of which few are wrong; one pass, a counter per cell."""
    margin, wrong = F.col("event_id") % 20, F.col("event_type") == "error"
    cells = [(t, m) for t in TAUS for m in MARGINS]
    sure = lambda t, m: (F.col("value") >= t) & (margin >= m)
    one = c.table("events").agg(
        *(F.count_if(sure(t, m)).alias(f"n_{t}_{m}") for t, m in cells), *(F.count_if(sure(t, m) & wrong).alias(f"w_{t}_{m}") for t, m in cells)
    )
    rows = F.array(*(F.struct(F.lit(t).alias("tau"), F.lit(m).alias("margin"), F.col(f"n_{t}_{m}").alias("n"), F.col(f"w_{t}_{m}").alias("wrong")) for t, m in cells))
    rows = one.select(F.explode(rows).alias("r")).select("r.*").filter(F.col("wrong") <= MOST_WRONG * F.col("n"))
    return rows.agg(F.max(F.struct("n", "tau", "margin")).alias("b")).select("b.n", "b.tau", "b.margin")


def next_places(c: Catalogue) -> DataFrame:
    """The next free line of each order."""
    return c.table("lineitem").groupBy("l_orderkey").agg((F.max("l_linenumber") + 1).alias("next_line"))
