"""SQL of the quality score."""

from __future__ import annotations

from cadenza.functions.curves import CREST, HF_RATIO, MID_SNR, TILT, curve_sql
from cadenza.functions.quality import CROWD_SNR


def _mean(a: str, wa: float, b: str, wb: float) -> str:
    return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN NULL ELSE (coalesce({a} * {wa}, 0) + coalesce({b} * {wb}, 0)) / (CASE WHEN {a} IS NULL THEN 0 ELSE {wa} END + CASE WHEN {b} IS NULL THEN 0 ELSE {wb} END) END"


def _log(group: str, weight: float) -> str:
    return f"coalesce({weight} * ln(greatest({group}, 1)), 0)"


def _weight(group: str, weight: float) -> str:
    return f"CASE WHEN {group} IS NULL THEN 0 ELSE {weight} END"


_W = {"tone": 0.35, "noise": 0.15, "dynamics": 0.5}

ORACLES = {
    "scored_recordings": f"""WITH f AS (SELECT l_partkey % 5 AS s, CASE WHEN l_partkey % 3 > 0 THEN -l_quantity / 3 END AS tilt, CASE WHEN l_partkey % 4 > 0 THEN -p_size::DOUBLE - 15 END AS hf,
  CASE WHEN l_partkey % 6 > 0 THEN p_size::DOUBLE END AS mid, CASE WHEN l_partkey % 3 > 0 THEN l_quantity / 2 END AS crowd, CASE WHEN l_partkey % 12 > 0 THEN l_quantity / 2 END AS crest,
  CASE WHEN l_partkey % 10 = 0 THEN l_quantity / 100 END AS clip, CASE WHEN l_partkey % 14 = 0 THEN -l_quantity - 30 END AS channel, l_quantity / 50 - 0.35 AS phase, l_linenumber AS gaps
  FROM lineitem JOIN part ON p_partkey = l_partkey),
 k AS (SELECT *, {curve_sql("tilt", TILT)} AS a, {curve_sql("hf", HF_RATIO)} AS b, {curve_sql("mid", MID_SNR)} AS c, {curve_sql("crowd", CROWD_SNR)} AS d, {curve_sql("crest", CREST)} AS dynamics FROM f),
 g AS (SELECT *, {_mean("a", 0.5, "b", 0.5)} AS tone, {_mean("c", 0.6, "d", 0.4)} AS noise,
  CASE WHEN clip > 0.01 THEN round(least(25, 5 + 20 * least(1, (clip - 0.01) / 0.5)), 1) ELSE 0 END + CASE WHEN channel < -60 THEN 30 ELSE 0 END + CASE WHEN phase < -0.3 THEN 20 ELSE 0 END + CASE WHEN gaps >= 3 THEN 10 ELSE 0 END AS taken,
  coalesce((clip > 0.01)::INT, 0) + coalesce((channel < -60)::INT, 0) + (phase < -0.3)::INT + (gaps >= 3)::INT AS issues FROM k),
 w AS (SELECT *, {" + ".join(_weight(n, x) for n, x in _W.items())} AS weight, {" + ".join(_log(n, x) for n, x in _W.items())} AS logs FROM g),
 q AS (SELECT *, CASE WHEN weight > 0 THEN least(100, greatest(0, exp(logs / weight) + [1.5, 0, -3, 2, 0][s + 1] - taken)) END AS composite FROM w)
 SELECT CASE WHEN composite * 0.5956 + 40.592 >= 85 THEN 'high' WHEN composite * 0.5956 + 40.592 >= 70 THEN 'medium' WHEN composite IS NOT NULL THEN 'low' END AS band,
 count(*) AS n, round(avg(composite), 6) AS composite, round(avg(noise), 6) AS noise, sum(issues)::BIGINT AS issues FROM q GROUP BY 1""",
}
