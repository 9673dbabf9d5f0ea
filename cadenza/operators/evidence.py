"""What sources say of a show, weighed: dates with rivals and calibrated confidence, and what may be shared."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.names import binned
from cadenza.operators.resolve import date_candidates
from cadenza.sources.catalogue import Catalogue

# A source's weight, the share of it for a less precise date, what mentions in the text add and take, and the score of no date.
WEIGHT = {"tags": 10.0, "folder": 4.0, "info": 3.0}
PARTIAL, NONE = 0.3, 1.0
SUPPORT_EACH, SUPPORT_MOST, AGAINST_EACH, AGAINST_MOST = 0.5, 1.0, 0.75, 1.5
#: Of equally precise dates the one of the first source is chosen.
SOURCES = ("tags", "info", "folder")
#: The release status with which a linked recording may be shared.
SHARED_STATUS = "bootleg"


@dataclass(frozen=True)
class Model:
    """A field's calibration: bins of the logit (from, below, p), and the least p, margin and logit that make a value sure."""

    tau: float
    margin: float
    bins: tuple[tuple[float | None, float | None, float], ...] = ()
    least: float | None = None


def assessed(score: Column, rivals: Column, none: float, model: Model) -> dict[str, Column]:
    """logit, margin, p and label of a score against an array of rivals' scores and that of nothing."""
    pool = F.concat(rivals, F.array(F.lit(none)))
    most = F.array_max(pool)
    mass = F.aggregate(pool, F.lit(0.0), lambda s, x: s + F.exp(x - most))
    logit, margin = score - most - F.ln(mass), score - most
    p = F.when(score <= none, 0.0).otherwise(binned(logit, list(model.bins), 1 / (1 + F.exp(-logit))))
    sure = (p >= model.tau) & (margin >= model.margin) & (F.lit(True) if model.least is None else logit >= model.least)
    return {"logit": logit, "margin": margin, "p": p, "label": F.when(score <= none, "empty").when(sure, "confident").otherwise("tentative")}


def _known(x: Column) -> Column:
    return sum((F.when(x[p].isNotNull(), 1).otherwise(0) for p in "ymd"), F.lit(0))


def _same(a: Column, b: Column) -> Column:
    return a["y"].eqNullSafe(b["y"]) & a["m"].eqNullSafe(b["m"]) & a["d"].eqNullSafe(b["d"])


def _fits(a: Column, b: Column) -> Column:
    """No part that both state differs."""
    out = F.lit(True)
    for p in "ymd":
        out = out & F.coalesce(a[p] == b[p], F.lit(True))
    return out


def weighed_dates(candidates: DataFrame, key: str, model: Model) -> DataFrame:
    """key, source, y, m, d, score, conflict, logit, margin, p, label: the date that a show's sources support.

    ``candidates`` has at most one row of each source (tags, info, folder): key, source, y, m, d, and for the info text how many
    other mentions agree (support) and state another date (against).  The most precise date is chosen, of equally precise
    ones that of the first source.  A date scores the weight of the sources that state it, and a share of that of sources
    that state less but nothing else; only dates that contradict the chosen one are its rivals.
    """
    place = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")).cast("int")
    weight = F.coalesce(*(F.when(F.col("source") == s, w) for s, w in WEIGHT.items()))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    extra = F.least(F.lit(SUPPORT_MOST), SUPPORT_EACH * zero("support")) - F.least(F.lit(AGAINST_MOST), AGAINST_EACH * zero("against"))
    one = F.struct(place.alias("place"), "source", "y", "m", "d", weight.alias("weight"), F.when(F.col("source") == "info", extra).otherwise(0.0).alias("extra"))
    rows = candidates.filter("y IS NOT NULL OR m IS NOT NULL OR d IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("c"))

    def score(t: Column) -> Column:
        partial = lambda v: (_known(v) < _known(t)) & _fits(v, t)
        return F.aggregate("c", F.lit(0.0), lambda s, v: s + F.when(_same(v, t), v["weight"] + v["extra"]).when(partial(v), v["weight"] * PARTIAL).otherwise(0.0))

    rated = F.transform("c", lambda t: F.struct((-_known(t)).alias("known"), t["place"].alias("place"), t["source"].alias("source"), t["y"].alias("y"), t["m"].alias("m"), t["d"].alias("d"), score(t).alias("score")))
    rows = rows.withColumn("c", rated).withColumn("best", F.array_min("c"))
    # dates that several sources state are one rival
    dates = F.array_distinct(F.transform(F.filter("c", lambda t: ~_fits(t, F.col("best"))), lambda t: F.struct(t["y"].alias("y"), t["m"].alias("m"), t["d"].alias("d"), t["score"].alias("score"))))
    rows = rows.withColumn("rivals", F.transform(dates, lambda t: t["score"]))
    conflict = F.exists("c", lambda a: F.exists("c", lambda b: ~_fits(a, b)))
    found = assessed(F.col("best.score"), F.col("rivals"), NONE, model)
    return rows.select(key, *(F.col(f"best.{x}").alias(x) for x in ("source", "y", "m", "d", "score")), conflict.alias("conflict"), *(c.alias(n) for n, c in found.items()))


def shareable(location: Column, kind: Column, official: Column, release: Column, status: Column) -> Column:
    """Whether a recording may leave: in the library, live, not official, and linked to no release or to a bootleg; what is not known is no."""
    linked = F.coalesce(release, F.lit("")) != ""
    return F.coalesce((location == "library") & (kind == "live") & ~official & (~linked | (F.lower(F.coalesce(status, F.lit(""))) == SHARED_STATUS)), F.lit(False))


#: A calibration with gaps, for the stand-in's dates.
MODEL = Model(tau=0.9, margin=2.0, bins=((None, 0.0, 0.2), (0.0, 3.0, 0.6), (8.0, None, 0.99)), least=1.0)


def weighed_candidates(c: Catalogue) -> DataFrame:
    key = F.col("item")
    named = F.element_at(F.array(*map(F.lit, SOURCES)), F.col("source") + 1)
    rows = date_candidates(c).select("item", named.alias("source"), "y", "m", "d", (key % 4).cast("int").alias("support"), F.when(key % 5 == 1, 3).otherwise(0).alias("against"))
    out = weighed_dates(rows, "item", MODEL)
    return out.select("item", "source", "y", "m", "d", "conflict", "label", *(F.round(x, 6).alias(x) for x in ("score", "logit", "margin", "p")))


def shareable_recordings(c: Catalogue) -> DataFrame:
    """Recordings by whether they may be shared, some of them linked to releases of several kinds."""
    key = F.col("performance_id")
    release = F.when(key % 3 == 0, F.concat(F.lit("r"), key)).when(key % 3 == 1, "")
    status = F.when(key % 9 == 0, "Bootleg").when(key % 9 == 3, "Official")
    may = shareable(F.col("location"), F.col("kind"), F.col("is_official"), release, status)
    return c.recording.groupBy(may.alias("shareable"), (key % 9).cast("int").alias("release")).agg(F.count("*").alias("n"))
