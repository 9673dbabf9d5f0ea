"""Templates read back, signals row by row, and streams with rows out of order, late rows and a restart."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions.signals import FEATURES, envelope, signal_features
from cadenza.functions.templates import Template, TemplateError
from cadenza.streaming import offers
from cadenza.streaming.play_log import EVENTS

FIELDS = ["artist", "year", "month", "day", "city", "title", "track"]


def render(spark, template, **values):
    t = Template(template, FIELDS)
    row = spark.range(1).select(*(F.lit(values.get(f)).cast("string").alias(f) for f in FIELDS))
    named = row.select(t.render({f: F.col(f) for f in FIELDS}).alias("name"))
    out = named.select("name", *(c.alias(f) for f, c in t.parse(F.col("name")).items())).first().asDict()
    return out.pop("name"), out


def test_groups_go_with_their_fields(spark):
    template = "{artist} {year}[-{month:pad2}[-{day:pad2}]][ ({city})]"
    full = dict(artist="The Band", year=1969, month=8, day=3, city="Bethel")
    name, read = render(spark, template, **full)
    assert name == "The Band 1969-08-03 (Bethel)" and read == dict(artist="The Band", year="1969", month="08", day="03", city="Bethel")
    assert render(spark, template, artist="A", year=1969, day=3) == ("A 1969", dict(artist="A", year="1969", month=None, day=None, city=None))
    assert render(spark, template, artist="A (B)", year=1969, month=12, city=" ")[1]["artist"] == "A (B)"
    assert render(spark, "{artist:upper} - {title:title}", artist="a/b: c?", title="go ON") == ("AB C - Go On", dict(artist="AB C", title="Go On"))
    assert render(spark, "[{city}]")[0] is None and render(spark, "{track:pad2}.{title:first}", track=7, title="x") == ("07.x", dict(track="07", title="x"))
    assert render(spark, "{artist}+{year}", artist="a.*b", year=1999)[1] == dict(artist="a.b", year="1999")


@pytest.mark.parametrize("template", ["", "{wrong}", "{artist", "artist}", "[x", "x]", "a/b", "a\\b", "{artist:wrong}", "{{artist}}"])
def test_wrong_templates(template):
    with pytest.raises(TemplateError):
        Template(template, FIELDS)


def _plain(x, rate, frame):
    """The features of one signal, sample by sample."""
    x = np.array([0.0 if v is None or not np.isfinite(v) else v for v in x])
    db = lambda p: max(10 * np.log10(max(p, 1e-20)), -140.0)
    hann = np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / frame) for i in range(frame)])
    y, spectra, at = x - x.mean(), [], 0
    while True:
        part = np.zeros(frame)
        part[: len(y[at : at + frame])] = y[at : at + frame]
        spectra.append(np.abs(np.fft.rfft(part * hann)) ** 2)
        if at + frame >= len(y):
            break
        at += frame // 2
    power, hz = np.array(spectra), np.arange(frame // 2 + 1) * rate / frame
    mean, noise = power.mean(0), np.percentile(power, 5, axis=0)
    clips, run = 0, 0
    for v in [*np.abs(x), 0.0]:
        if v >= 0.999:
            run += 1
        else:
            clips, run = clips + (run >= 3), 0
    out = dict(rms_db=db((x * x).mean()), peak_db=db(max(x * x)), clipped_share=(np.abs(x) >= 0.999).mean(), n_clips=clips, dc_offset=x.mean(), zero_crossings=sum((a < 0) != (b < 0) for a, b in zip(x, x[1:])))
    out["crest_db"] = out["peak_db"] - out["rms_db"]
    quiet = mean.sum() <= 1e-20
    music = np.maximum(mean - noise, 1e-20)
    rolloff = next(f for f, s in zip(hz, np.cumsum(music)) if s >= 0.95 * np.cumsum(music)[-1])
    slope = np.polyfit(np.log2(hz[1:]), [db(p) for p in mean[1:]], 1)[0]
    flat = np.exp(np.mean([np.log(max(p, 1e-20)) for p in mean[1:]])) / max(mean[1:].mean(), 1e-20)
    rest = dict(flatness=flat, centroid=(mean * hz).sum() / max(mean.sum(), 1e-20), rolloff_95=rolloff, tilt_db_oct=slope, snr_db=db(mean.sum()) - db(noise.sum()))
    return out | {k: 0.0 if quiet else v for k, v in rest.items()}


def test_signals_row_by_row(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(v) for v in r.normal(0, 0.4, n)], 1) for i, n in enumerate([1, 2, 8, 9, 33, 33, 64, 500])]
    rows += [(20, [1.0] * 5 + [-0.2] + [1.0] * 2 + [-1.0] * 3, 1), (21, [0.0] * 40, 1), (22, [None, 0.5, float("nan"), -0.5], 1), (23, [0.3] * 20, 1), (30, None, 1), (31, [], 1)]
    table = spark.createDataFrame(rows, "rms_db_ long, x array<double>, n_ int").repartition(3)
    got = {g.rms_db_: g.asDict() for g in signal_features(table, "rms_db_", "x", rate=8.0, frame=8).collect()}
    assert all(got[i][f] is None for i in (30, 31) for f in FEATURES) and got[31]["n"] == 0
    for i, x, _ in rows[:-2]:
        assert {f: got[i][f] for f in FEATURES} == pytest.approx(_plain(x, 8.0, 8), abs=1e-6), i
    assert signal_features(table.limit(0), "rms_db_", "x").isEmpty()


def test_envelope_of_short_signals():
    assert envelope(np.array([0.5, -0.25]), 800) == ([100, -50], [100, -50])
    assert envelope(np.array([0.1, -0.2, 0.2, 0.4, 9.0]), 2) == ([-50, 50], [25, 100])
    assert envelope(np.zeros(4), 2) == ([0, 0], [0, 0])


def _events(r, n):
    start = dt.datetime(2024, 1, 1)
    rows, at = [], start
    for i in range(n):
        at += dt.timedelta(minutes=r.randint(0, 40), microseconds=r.randint(0, 9))
        rows.append((i, at, r.randint(1, 4), r.choice(["view", "view", "purchase", "error"]), 1.0, "{}"))
    return rows


def _run(spark, tmp_path, batches, make, mode="append"):
    """The result of a stream that gets one file at a time and is started anew for each."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
        stream = make(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder)))
        run = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(out)


def _late(rows, r, by):
    """The same rows, each at most ``by`` later in order than its time."""
    return sorted(rows, key=lambda x: x[1] + dt.timedelta(minutes=r.randint(0, by)))


END = (10_000, dt.datetime(2030, 1, 1), 99, "view", 1.0, "{}")


def test_offers_come_back_whatever_the_order(spark, tmp_path):
    r = random.Random(3)
    rows = _events(r, 60)
    mixed = _late(rows, r, 90)
    got = _run(spark, tmp_path, [mixed[:25], mixed[25:], [END]], lambda s: offers.returned_stream(s, 1800))
    want = offers.returned(spark.createDataFrame(rows, EVENTS), 1800)
    assert sorted(map(tuple, got.filter("user_id <> 99").collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_sessions_and_rows_that_are_too_late(spark, tmp_path):
    r = random.Random(5)
    rows = _events(r, 50)
    too_late = (9_000, dt.datetime(2023, 1, 1), 1, "view", 1.0, "{}")
    got = _run(spark, tmp_path, [_late(rows, r, 90), [too_late], [END]], lambda s: offers.sessions(s, "1 hour"))
    want = offers.sessions(spark.createDataFrame(rows, EVENTS), "1 hour")
    assert sorted(map(tuple, got.filter("user_id <> 99").collect())) == sorted(map(tuple, want.collect()))


def test_repeated_events_within_the_delay(spark, tmp_path):
    rows = _events(random.Random(6), 20)
    again = [*rows[:5], *rows]
    got = _run(spark, tmp_path, [rows[:10], again[:5] + rows[10:], rows[18:]], lambda s: offers.first_seen(s, "30 days"))
    assert sorted(x.event_id for x in got.collect()) == [x[0] for x in rows]
