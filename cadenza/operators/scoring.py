"""Scores and statistics as expressions: curves, group-relative baselines, bins, fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.curves import CREST, DUR_REL, FLAT_REL, GROUP_WEIGHTS, HF_RATIO, MID_SNR, SOURCE_OFFSET, TILT, curve, geometric
from cadenza.functions.quality import scored
from cadenza.operators.checks import indexed_quantiles
from cadenza.sources.catalogue import Catalogue


def quality_composite(c: Catalogue) -> DataFrame:
    """Tone, noise and dynamics from part and line figures, their geometric mean, source offset, clip."""
    rows = c.table("lineitem").join(c.table("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    tone = 0.5 * curve(-F.col("l_quantity") / 3, TILT) + 0.5 * curve(-F.col("p_size") - 15, HF_RATIO)
    groups = {"tone": tone, "noise": curve(F.col("p_size").cast("double"), MID_SNR), "dynamics": curve(F.col("l_quantity") / 2, CREST)}
    source = F.when(F.col("l_returnflag") == "A", SOURCE_OFFSET["SBD"]).when(F.col("l_returnflag") == "N", SOURCE_OFFSET["FM"]).otherwise(SOURCE_OFFSET["AUD"])
    score = F.least(F.greatest(geometric(groups, GROUP_WEIGHTS) + source, F.lit(0.0)), F.lit(100.0))
    rows = rows.select("l_returnflag", score.alias("score"))
    return rows.groupBy("l_returnflag").agg(
        F.count("*").alias("n"),
        F.round(F.avg("score"), 6).alias("mean"),
        F.count_if(F.col("score") >= 85).alias("high"),
        F.count_if((F.col("score") >= 70) & (F.col("score") < 85)).alias("medium"),
        F.count_if(F.col("score") < 70).alias("low"),
    )


def non_music(c: Catalogue) -> DataFrame:
    """Tracks against their recording: flatness over its quartile, length over its median; four tracks at least."""
    rows = c.track.groupBy(F.floor(F.col("recording_id") / 10).alias("recording"), "track_number").agg(F.max("flatness").alias("flatness"), F.max("duration").alias("duration"))
    by = Window.partitionBy("recording")
    rows = rows.withColumns({"n": F.count("*").over(by), "low": F.percentile("flatness", F.lit(0.25)).over(by), "mid": F.percentile("duration", F.lit(0.5)).over(by)}).filter("n >= 4")
    score = 0.5 * curve(F.col("flatness") / F.col("low"), FLAT_REL) + 0.5 * curve(F.col("duration") / F.col("mid"), DUR_REL)
    return rows.select("recording", "track_number", F.round(score, 9).alias("score"))


def completeness(c: Catalogue) -> DataFrame:
    """Share of a show's fields that are known, with thirds for the date, and its band."""
    known = lambda x: F.col(x).isNotNull().cast("int")
    score = 100.0 * ((known("y") + known("m") + known("d")) / 3 + known("venue_id") + known("artist_id")) / 3
    rows = c.performance.select("id", F.round(score, 6).alias("score"))
    return rows.withColumn("band", F.when(F.col("score") >= 85, "green").when(F.col("score") >= 60, "yellow").otherwise("red"))


def fit_statistics(c: Catalogue) -> DataFrame:
    """Correlation, mean absolute error, slope and intercept per source."""
    rows = c.table("lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return rows.groupBy("l_returnflag").agg(
        F.count("*").alias("n"),
        F.round(F.corr("x", "y"), 8).alias("r"),
        F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 6).alias("mae"),
        F.round(F.regr_slope("y", "x"), 6).alias("slope"),
        F.round(F.regr_intercept("y", "x"), 6).alias("intercept"),
    )


def confusion(c: Catalogue) -> DataFrame:
    """Labels against a band from length."""
    rows = c.table("labels").join(c.table("documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy("quality").agg(F.count_if(F.col("n_chars") >= 2000).alias("long"), F.count_if(F.col("n_chars") < 2000).alias("short"))


def smoothed_bins(c: Catalogue) -> DataFrame:
    """Laplace-smoothed share of right ones per bin of evidence."""
    rows = c.table("events").select(F.least(F.floor(F.col("value") / 5), F.lit(20)).cast("int").alias("bin"), (F.col("event_type") == "purchase").alias("right"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), ((F.count_if("right") + 1) / (F.count("*") + 2)).alias("rate"))


def isotonic_bins(c: Catalogue) -> DataFrame:
    """Pool adjacent violators over the bins (21 by definition), weighed by their smoothed counts, n + 2."""
    from cadenza.functions.isotonic import isotonic

    return isotonic(smoothed_bins(c).withColumn("weight", F.col("n") + 2), "bin", "rate", "weight").withColumnRenamed("weight", "n")


def latency_quantiles(c: Catalogue) -> DataFrame:
    """The value at each share of the events by place, and the median; ranked range by range, so that no task holds a whole kind."""
    found = indexed_quantiles(c.table("events"), "event_type", "value", {"p90": 0.9, "p95": 0.95, "p99": 0.99})
    return found.select("event_type", F.round("median", 6).alias("p50"), "p90", "p95", "p99", "most", F.round("mean", 6).alias("mean"))


def waveform(c: Catalogue, buckets: int = 8) -> DataFrame:
    """Largest magnitude of each bucket of a vector."""
    rows = c.table("embeddings").select("vec_id", F.size("embedding").alias("n"), F.posexplode("embedding").alias("pos", "x"))
    rows = rows.withColumn("bucket", F.floor(F.col("pos") * buckets / F.col("n")).cast("int"))
    return rows.groupBy("vec_id", "bucket").agg(F.max(F.abs("x")).cast("double").alias("peak"))


def evidence(c: Catalogue) -> DataFrame:
    """Evidence pooled per candidate: sum of scores, and a bonus for sources that agree (two at most count)."""
    rows = c.table("events").select((F.col("event_id") % 500).alias("item"), (F.col("user_id") % 5).alias("cand"), F.col("event_type").alias("source"), "value")
    pooled = rows.groupBy("item", "cand").agg((F.sum("value") / 10).alias("base"), F.countDistinct("source").alias("sources"))
    return pooled.select("item", "cand", (F.col("base") + 3.0 * F.least(F.col("sources") - 1, F.lit(2))).alias("score"))


def confidence(c: Catalogue) -> DataFrame:
    """Logit of each item's best candidate against its rivals and against none (score 0), and its margin."""
    rows = evidence(c)
    by = Window.partitionBy("item").orderBy(F.desc("score"), "cand")
    rows = rows.withColumn("place", F.row_number().over(by))
    best = F.max(F.when(F.col("place") == 1, F.col("score")))
    second = F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), F.lit(0.0))
    top = F.greatest(second, F.lit(0.0))
    rows = rows.groupBy("item").agg(
        F.max(F.when(F.col("place") == 1, F.col("cand"))).alias("cand"),
        best.alias("score"),
        top.alias("m"),
        F.collect_list(F.when(F.col("place") > 1, F.col("score"))).alias("rivals"),
        (best - second).alias("margin"),
    )
    logs = F.col("m") + F.log(F.exp(-F.col("m")) + F.aggregate("rivals", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("m"))))
    return rows.select("item", "cand", F.round("margin", 6).alias("margin"), F.round(F.col("score") - logs, 6).alias("logit"))


def confidence_gates(c: Catalogue, tau: float = 0.6, margin: float = 0.5, least: float = 0.0) -> DataFrame:
    """Chance of each item's best candidate, and whether it passes the gates on chance, margin and logit."""
    rows = confidence(c)
    chance = 1 / (1 + F.exp(-F.col("logit")))
    good = (F.round(chance, 6) >= tau) & (F.col("margin") >= margin) & (F.col("logit") >= least)
    return rows.select("item", "cand", F.round(chance, 6).alias("chance"), good.alias("confident"))


def _figures(c: Catalogue) -> DataFrame:
    """Figures of each line: quantities and sizes taken for measurements, some of them unknown."""
    n, size, part = F.col("l_quantity").cast("double"), F.col("p_size").cast("double"), F.col("l_partkey")
    rows = c.table("lineitem").join(c.table("part"), part == F.col("p_partkey"))
    known = lambda by, x: F.when(part % by > 0, x)
    return rows.select(
        F.struct("l_orderkey", "l_linenumber", part, "l_suppkey", "l_shipdate", "l_quantity").alias("line"),
        F.when(part % 5 == 0, "radio mix").when(part % 5 == 1, " sbd > dat").when(part % 5 == 2, "Aud").when(part % 5 == 3, "mtx").alias("source"),
        known(3, -n / 3).alias("spectral_tilt_db_oct"), known(4, -size - 15).alias("hf_energy_ratio_db"), known(6, size).alias("mid_snr_db"), known(3, n / 2).alias("crowd_snr_db"),
        known(12, n / 2).alias("crest_factor_db"), F.when(part % 10 == 0, n / 100).alias("clipping_pct"), F.when(part % 14 == 0, -n - 30).alias("channel_rms_min_db"),
        (n / 50 - 0.35).alias("phase_correlation"), F.col("l_linenumber").alias("dropout_count"),
    )


def scored_recordings(c: Catalogue) -> DataFrame:
    """Bands of lines with their mean composite and what was broken."""
    rows = scored(_figures(c), "line")
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("composite"), 6).alias("composite"), F.round(F.avg("noise"), 6).alias("noise"), F.sum(F.size("issues")).alias("issues"))
