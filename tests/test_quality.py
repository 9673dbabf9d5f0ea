"""The quality score of rows made by hand."""

import numpy as np
import pytest

from cadenza.functions.curves import CREST, HF_RATIO, MID_SNR, TILT
from cadenza.functions.quality import CROWD_SNR, METRICS, scored


def by_hand(row, source):
    at = lambda name, points: None if row[name] is None else float(np.interp(row[name], *zip(*points)))

    def mean(*parts):
        live = [(s, w) for s, w in parts if s is not None]
        return sum(s * w for s, w in live) / sum(w for _, w in live) if live else None

    groups = {
        0.35: mean((at("spectral_tilt_db_oct", TILT), 0.5), (at("hf_energy_ratio_db", HF_RATIO), 0.5)),
        0.15: mean((at("mid_snr_db", MID_SNR), 0.6), (at("crowd_snr_db", CROWD_SNR), 0.4)),
        0.5: at("crest_factor_db", CREST),
    }
    live = {w: s for w, s in groups.items() if s is not None}
    if not live:
        return None, 0
    base = np.exp(sum(w * np.log(max(s, 1)) for w, s in live.items()) / sum(live))
    taken, clip = [], row["clipping_pct"]
    if clip is not None and clip > 0.01:
        taken.append(round(min(25, 5 + 20 * min(1, (clip - 0.01) / 0.5)), 1))
    taken += [30] * ((row["channel_rms_min_db"] or 0) < -60) + [20] * ((row["phase_correlation"] or 0) < -0.3) + [10] * ((row["dropout_count"] or 0) >= 3)
    return min(100, max(0, base + source - sum(taken))), len(taken)


def test_scores(spark):
    r = np.random.default_rng(2)
    spans = dict(zip(METRICS, [(-22, 1), (-75, -5), (4, 42), (8, 42), (3, 38), (0, 0.6), (-80, -20), (-0.6, 1), (0, 5)]))
    sources = [("SBD > DAT", 0), (" fm peterw", 1.5), ("Radio", 1.5), ("mtx", 2), ("AUD", -3), (None, 0), ("?", 0)]
    rows = []
    for i in range(60):
        row = {m: None if r.random() < 0.25 else float(r.uniform(*spans[m])) for m in METRICS}
        rows.append((i, *row.values(), sources[i % 7][0]))
    rows.append((60, *[None] * 9, "SBD"))
    table = spark.createDataFrame(rows, "id int, " + ", ".join(f"{m} double" for m in METRICS) + ", source string")
    for got in scored(table, "id").collect():
        row = dict(zip(METRICS, rows[got.id][1:]))
        want, broken = by_hand(row, sources[got.id % 7][1])
        assert got.composite == (None if want is None else pytest.approx(want))
        if want is not None:
            grade = min(100, max(0, want * 0.5956 + 40.592))
            assert len(got.issues) == broken and got.grade == pytest.approx(grade) and got.band == ("high" if grade >= 85 else "medium" if grade >= 70 else "low")
    assert [g.band for g in scored(table.filter("id = 60"), "id").collect()] == [None]
