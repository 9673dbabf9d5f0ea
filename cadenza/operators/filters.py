"""Predicates, lookups, ordered reports and plain aggregates of the catalogue.

Null columns match no predicate unless a rule says otherwise; empty tables give no
rows (global aggregates: one row of nulls); ties end on the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.sources.catalogue import Catalogue


def name_contains(c: Catalogue, token: str = "red") -> DataFrame:
    return c.table("part").filter(F.col("p_name").contains(token)).select("p_partkey", "p_name")


def begins_in(c: Catalogue, prefix: str = "1997-") -> DataFrame:
    """Shows whose ISO date begins with the prefix."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return c.table("orders").withColumn("begin_date", day).filter(F.col("begin_date").startswith(prefix)).select("o_orderkey", "begin_date")


def listed_statuses(c: Catalogue, wanted: tuple[str, ...] = ("F", "P"), refused: tuple[str, ...] = ("1-URGENT", "5-LOW")) -> DataFrame:
    """IN one list and NOT IN another."""
    rows = c.table("orders").filter(F.col("o_orderstatus").isin(*wanted) & ~F.col("o_orderpriority").isin(*refused))
    return rows.select("o_orderkey", "o_orderstatus", "o_orderpriority")


def bounded(text: Column, default: int, lo: int, hi: int) -> Column:
    """An integer argument: the default if it does not parse, else clamped."""
    return F.least(F.greatest(F.coalesce(F.try_to_number(F.when(text.rlike("^[+-]?[0-9]{1,9}$"), text), F.lit("S999999999")).cast("int"), F.lit(default)), F.lit(lo)), F.lit(hi))


def bounded_arguments(c: Catalogue) -> DataFrame:
    """The page argument of every URL: 1 where absent or not a number, at most 50."""
    raw = F.nullif(F.regexp_extract("url", "[?&]page=([^&#]*)", 1), F.lit(""))
    return c.table("pages").select("page_id", raw.alias("raw"), bounded(raw, 1, 1, 50).alias("page"))


def whole_word(c: Catalogue, word: str = "red") -> DataFrame:
    padded = F.concat(F.lit(" "), F.lower("p_name"), F.lit(" "))
    return c.table("part").filter(F.contains(padded, F.lit(f" {word} "))).select("p_partkey", "p_name")


def archive_lookup(c: Catalogue) -> DataFrame:
    """Dated shows against archive items (a line's ship date) on act, year, month and day."""
    acts = c.table("customer").select(F.col("c_custkey").alias("artist_id"), F.lower("c_name").alias("act"))
    items = c.table("lineitem").join(c.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(acts, F.col("o_custkey") == F.col("artist_id"))
    items = items.groupBy("act", F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"), F.dayofmonth("l_shipdate").alias("d")).agg(F.count("*").alias("n_items"))
    shows = c.performance.filter("d IS NOT NULL").join(acts, "artist_id").select("id", "act", "y", "m", "d")
    return shows.join(items, ["act", "y", "m", "d"]).select("id", "act", "n_items")


def paged_recordings(c: Catalogue, limit: int = 500, offset: int = 20, most: int = 100) -> DataFrame:
    """A page of the newest recordings; the limit is clamped to 1..most (a top-k report)."""
    rows = c.recording.select("id", "source", "created_at").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    return rows.offset(max(offset, 0)).limit(min(max(limit, 1), most))


def skipped_last(c: Catalogue, n: int = 100) -> DataFrame:
    """Queue report: CASE as the first sort key, skipped (P) last."""
    last = F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    return c.table("orders").orderBy(last, "o_orderpriority", "o_orderkey").limit(n).select("o_orderkey", "o_orderstatus", "o_orderpriority")


def quality_sorted(c: Catalogue, n: int = 100) -> DataFrame:
    """Score descending, then quality (unknown is -1), then year, month, day descending (unknown is 0)."""
    rows = c.recording.join(c.performance.select(F.col("id").alias("performance_id"), "y", "m", "d"), "performance_id")
    grade = F.when(F.col("quality") == "A", 2).when(F.col("quality") == "B", 1)
    score = F.col("id") % 5
    keys = [F.desc("score"), F.desc(F.coalesce("grade", F.lit(-1))), F.desc(F.coalesce("y", F.lit(0))), F.desc(F.coalesce("m", F.lit(0))), F.desc(F.coalesce("d", F.lit(0))), F.asc("id")]
    return rows.select("id", score.alias("score"), grade.alias("grade"), "y", "m", "d").orderBy(*keys).limit(n)


def errors_last(c: Catalogue, n: int = 100) -> DataFrame:
    """Scores descending, rows in error (no score) after all others."""
    score = F.when(F.col("event_type") != "error", F.col("value"))
    rows = c.table("events").filter("event_id % 7 = 0").select("event_id", score.alias("score"))
    return rows.orderBy(F.desc_nulls_last("score"), "event_id").limit(n)


def article_sorted(c: Catalogue, n: int = 50) -> DataFrame:
    """Names in order without their article."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("The "), F.col("p_name"))).otherwise(F.col("p_name"))
    rows = c.table("part").select("p_partkey", name.alias("name"), F.regexp_replace(F.lower(name), "^the ", "").alias("sort_key"))
    return rows.orderBy("sort_key", "p_partkey").limit(n)


def top_candidates(c: Catalogue, n: int = 5) -> DataFrame:
    """Per brand the best candidates: score, popularity, name, id."""
    by = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_name", "p_partkey")
    return c.table("part").withColumn("place", F.row_number().over(by)).filter(F.col("place") <= n).select("p_brand", "p_partkey", "place")


def run_rollup(c: Catalogue) -> DataFrame:
    """Per queue (user): items of all runs (days), but what waits only from the newest run."""
    rows = c.table("events").select("user_id", F.to_date("ts").alias("run"), "event_type")
    per = rows.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("waiting"))
    newest = per.groupBy("user_id").agg(F.max_by("waiting", "run").alias("waiting"), F.sum("n").alias("n_items"), F.count("*").alias("n_runs"))
    return newest.select("user_id", "n_items", "n_runs", "waiting")


def waiting_paths(c: Catalogue) -> DataFrame:
    """Distinct folders of the pages' URLs by host."""
    bare = F.regexp_replace("url", "[?#].*$", "")
    rows = c.table("pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_replace(bare, "/[^/]*$", "").alias("folder"))
    return rows.groupBy("host").agg(F.count_distinct("folder").alias("n_folders"))


def first_run(c: Catalogue) -> DataFrame:
    return c.table("events").agg(F.min("ts").alias("first_ts"))


def window_features(c: Catalogue) -> DataFrame:
    """Per show, over its lines: median, lower quartile, maximum, any, most common flag (the smallest of ties), first."""
    rows = c.table("lineitem").select("l_orderkey", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linenumber", "l_partkey")
    flags = rows.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    flags = flags.groupBy("l_orderkey").agg(F.min(F.struct(-F.col("n"), "l_returnflag")).alias("f")).select("l_orderkey", F.col("f.l_returnflag").alias("usual_flag"))
    out = rows.groupBy("l_orderkey").agg(
        F.percentile("l_quantity", F.lit(0.5)).alias("median"),
        F.percentile("l_quantity", F.lit(0.25)).alias("p25"),
        F.max("l_tax").alias("most_tax"),
        F.bool_or(F.col("l_discount") > 0.08).alias("any_discount"),
        F.min(F.struct("l_linenumber", "l_partkey")).alias("f"),
    )
    return out.join(flags, "l_orderkey").select("l_orderkey", "median", "p25", "most_tax", "any_discount", "usual_flag", F.col("f.l_partkey").alias("first_part"))


def weighted_means(c: Catalogue) -> DataFrame:
    """Weighted geometric (floor 1) and arithmetic mean of three measures, unknown ones left out with their weight."""
    parts = [(F.col("l_quantity"), 0.5), (F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax") * 1000), 0.3), (F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount") * 1000), 0.2)]
    total = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    logs = sum((F.coalesce(w * F.log(F.greatest(x, F.lit(1.0))), F.lit(0.0)) for x, w in parts), F.lit(0.0))
    plain = sum((F.coalesce(w * x, F.lit(0.0)) for x, w in parts), F.lit(0.0))
    rows = c.table("lineitem").select("l_orderkey", "l_linenumber", F.round(F.exp(logs / total), 6).alias("geometric"), F.round(plain / total, 6).alias("arithmetic"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("geometric").alias("geometric"), F.max("arithmetic").alias("arithmetic"))


def balanced_folds(c: Catalogue) -> DataFrame:
    """Nations by size, largest first, each to the smallest of three folds; only the group counts meet in one row."""
    counts = c.table("customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    packed = counts.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "c_nationkey", "n"))).alias("all"))
    step = """aggregate(all, struct(array(0L, 0L, 0L) AS load, array() AS folds), (s, x) ->
      struct(transform(s.load, (v, i) -> IF(i = array_position(s.load, array_min(s.load)) - 1, v + x.n, v)) AS load,
             concat(s.folds, array(cast(array_position(s.load, array_min(s.load)) - 1 AS int))) AS folds))"""
    step = step.replace("array() AS folds", "cast(array() AS array<int>) AS folds")
    rows = packed.selectExpr("all", f"{step} AS s").select(F.explode(F.arrays_zip("all", F.col("s.folds").alias("fold"))).alias("r"))
    return rows.select("r.all.c_nationkey", "r.all.n", "r.fold")


def cooled_down(c: Catalogue, seconds: int = 86_400) -> DataFrame:
    """Users whose last error is at least ``seconds`` old at the end of the log: offered again."""
    rows = c.table("events")
    end = rows.agg(F.max("ts").alias("now"))
    last = rows.filter("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("last"))
    age = F.unix_micros(F.to_timestamp("now")) - F.unix_micros(F.to_timestamp("last"))
    return last.join(F.broadcast(end)).filter(age >= seconds * 1_000_000).select("user_id", "last")


def resumable_work(c: Catalogue) -> DataFrame:
    """What a restarted run takes up: rows not done, those begun first, attempts left."""
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "begun").otherwise("new")
    rows = c.table("orders").select("o_orderkey", state.alias("state"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"))
    return rows.filter("state <> 'done' AND attempts < 3").withColumn("rank", F.when(F.col("state") == "begun", 0).otherwise(1))


def access_recency(c: Catalogue) -> DataFrame:
    """Each user's last access, and whether it lies in the last seven days of the log."""
    rows = c.table("events")
    last = rows.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.join(F.broadcast(rows.agg(F.max("ts").alias("now")))).select("user_id", "last", (F.col("last") >= F.col("now") - F.expr("INTERVAL 7 DAYS")).alias("recent"))


def run_duplicates(c: Catalogue) -> DataFrame:
    """Within a run (source), texts that an earlier document of the run holds: the first one wins."""
    rows = c.table("documents").select("source", "doc_id", F.sha2("text", 256).alias("digest")).filter("digest IS NOT NULL")
    first = rows.groupBy("source", "digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(first, ["source", "digest"]).filter("doc_id <> first_id").select("source", "doc_id", "first_id")


def allowed_attempts(c: Catalogue, most: int = 3, seconds: int = 3600) -> DataFrame:
    """Attempts that a sliding-window limit lets through: fewer than ``most`` allowed ones in the ``seconds`` before.

    Refused attempts do not count, so a user's attempts are folded in order; the state is a list of ``most`` times.
    """
    at = F.unix_micros(F.to_timestamp("ts"))
    rows = c.table("events").filter("event_type = 'error'").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "event_id"))).alias("all"))
    fold = f"""aggregate(all, struct(cast(array() AS array<bigint>) AS kept, cast(array() AS array<bigint>) AS ids), (s, x) ->
      IF(size(filter(s.kept, t -> t > x.at - {seconds * 1_000_000}L)) < {most},
         struct(concat(filter(s.kept, t -> t > x.at - {seconds * 1_000_000}L), array(x.at)) AS kept, concat(s.ids, array(x.event_id)) AS ids), s)).ids"""
    return rows.select("user_id", F.explode(F.expr(fold)).alias("event_id"))
