"""A recording's quality from its measured figures: groups, gates, grade and band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.curves import CREST, GROUP_WEIGHTS, HF_RATIO, MID_SNR, SOURCE_OFFSET, TILT, curve, geometric
from cadenza.functions.names import predicted_grade

# The curve of the crowd's noise, each figure's curve and weight in its group, and the bands of the predicted grade.
CROWD_SNR = [(10, 0), (14, 15), (17, 35), (20, 55), (23, 72), (26, 86), (28, 95), (31, 100), (40, 100)]
GROUPS = {
    "tone": {"spectral_tilt_db_oct": (TILT, 0.5), "hf_energy_ratio_db": (HF_RATIO, 0.5)},
    "noise": {"mid_snr_db": (MID_SNR, 0.6), "crowd_snr_db": (CROWD_SNR, 0.4)},
    "dynamics": {"crest_factor_db": (CREST, 1.0)},
}
HIGH, MEDIUM = 85.0, 70.0
METRICS = ["spectral_tilt_db_oct", "hf_energy_ratio_db", "mid_snr_db", "crowd_snr_db", "crest_factor_db", "clipping_pct", "channel_rms_min_db", "phase_correlation", "dropout_count"]


def group_score(figures: dict[str, tuple[list, float]]) -> Column:
    """Weighted mean of the figures that are known."""
    scores = {name: curve(F.col(name), points) for name, (points, _) in figures.items()}
    weight = sum((F.when(s.isNotNull(), figures[n][1]).otherwise(0.0) for n, s in scores.items()), F.lit(0.0))
    total = sum((F.coalesce(s * figures[n][1], F.lit(0.0)) for n, s in scores.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def issues() -> Column:
    """What is broken, with what it takes from the score: an array of (issue, deduction); unknown figures break nothing."""
    clip = F.least(F.lit(25.0), 5.0 + 20.0 * F.least(F.lit(1.0), (F.col("clipping_pct") - 0.01) / 0.5))
    gates = [
        ("clipping", F.col("clipping_pct") > 0.01, clip),
        ("dead channel", F.col("channel_rms_min_db") < -60, F.lit(30.0)),
        ("out of phase", F.col("phase_correlation") < -0.3, F.lit(20.0)),
        ("dropouts", F.col("dropout_count") >= 3, F.lit(10.0)),
    ]
    return F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(name).alias("issue"), F.round(takes, 1).alias("deduction"))) for name, broken, takes in gates)))


def source_offset(source: Column) -> Column:
    """What a source's text adds: by its first letters, whatever follows."""
    said = F.upper(F.trim(source))
    starts = [F.when(said.startswith(s), SOURCE_OFFSET[s]) for s in ("MTX", "SBD", "AUD", "FM")]
    return F.coalesce(*starts, F.when(said.startswith("RADIO"), SOURCE_OFFSET["FM"]), F.lit(0.0))


def scored(rows: DataFrame, key: str) -> DataFrame:
    """key, tone, noise, dynamics, issues, composite, grade, band of rows with METRICS and ``source``; without any figure all is null."""
    out = rows.select(key, "source", *(group_score(figures).alias(name) for name, figures in GROUPS.items()), issues().alias("issues"))
    base = geometric({name: F.col(name) for name in GROUPS}, GROUP_WEIGHTS)
    taken = F.aggregate("issues", F.lit(0.0), lambda total, x: total + x["deduction"])
    composite = F.when(base.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), base + source_offset(F.col("source")) - taken)))
    out = out.withColumn("composite", composite).withColumn("grade", predicted_grade(F.col("composite")))
    band = F.when(F.col("grade") >= HIGH, "high").when(F.col("grade") >= MEDIUM, "medium").when(F.col("grade").isNotNull(), "low")
    return out.withColumn("band", band).drop("source")
