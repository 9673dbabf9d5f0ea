"""Info texts read as units with features, and the units' roles decoded.

A unit is a stretch of one line: a date, a numbered track, a connector word, or a segment between separators.
Texts are read in Arrow batches, where they are; names of acts and venues are found by joins on
their normal form, so that a library of any size is no per-row dictionary.  What is shuffled are texts and
names that were found, never units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.decoding import Model, Present, Weights, best_paths
from cadenza.functions.units import FEATURES, KINDS, Units, slices
from cadenza.operators.dated import LATEST
from cadenza.sources.catalogue import Catalogue


def normal(text: Column) -> Column:
    """Lower case, letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def units(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 0, blank ones not counted), block, pos (in its line), last (pos of the line's last), kind, label, text, role (of a date): a row per unit.

    A numbered line is a track only beside another one.  Null and blank texts have no units.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = Units(part.column(1), LATEST)
                numbers = [pa.array(x.astype(np.int32)) for x in (found.line, found.block, found.pos, found.last)]
                of = [found.of_forms([f(u) for u in found.forms], pa.string()) for f in (lambda u: KINDS[u.kind], lambda u: u.label, lambda u: u.text, lambda u: u.role)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(found.text)), *numbers, *of], names=names)

    names = [key, "line", "block", "pos", "last", "kind", "label", "text", "role"]
    return texts.select(key, text).mapInArrow(run, f"`{key}` {_type(texts, key)}, line int, block int, pos int, last int, kind string, label string, text string, role string")


def _type(texts: DataFrame, key: str) -> str:
    return texts.schema[key].dataType.simpleString()


def with_known(texts: DataFrame, key: str, text: str, acts: DataFrame, venues: DataFrame) -> DataFrame:
    """key, text, known: each text with those of its segments' cores that are names, and whether of an act or of a venue.

    ``acts`` and ``venues`` have a column ``name``.  A core goes to the names once for all texts of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = Units(part.column(1), LATEST)
                code, of = found.named()
                every, first = np.unique(code, return_index=True)
                keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), part.column(0).take(pa.array(of)))
                yield pa.RecordBatch.from_arrays([pa.array(found.cores, pa.string()).take(pa.array(every)), keys], names=["core", "of"])

    names = acts.select(normal(F.col("name")).alias("core"), F.lit(True).alias("lib_artist"), F.lit(False).alias("lib_venue"))
    names = names.unionByName(venues.select(normal(F.col("name")).alias("core"), F.lit(False).alias("lib_artist"), F.lit(True).alias("lib_venue")))
    names = names.filter("core <> ''").groupBy("core").agg(F.max("lib_artist").alias("lib_artist"), F.max("lib_venue").alias("lib_venue"))
    cores = texts.select(key, text).mapInArrow(run, f"core string, of array<{_type(texts, key)}>")
    found = cores.join(names, "core").select(F.explode("of").alias(key), F.struct("core", "lib_artist", "lib_venue").alias("x"))
    return texts.select(key, text).join(found.groupBy(key).agg(F.collect_list("x").alias("known")), key, "left")


def feature_rows(texts: DataFrame, key: str) -> DataFrame:
    """feature (its place in FEATURES; null: all of one text), key, n: from texts ``with_known``.

    For each feature how many units have it, some at a time and without a key; for each text a row whose n has a bit for each of its features.
    """
    bits = 1 << np.arange(len(FEATURES), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = Units(part.column(1), LATEST)
                has = found.features(part.column(2))
                full = np.flatnonzero(np.diff(found.off))
                of_text = np.logical_or.reduceat(has, found.off[full], 0) @ bits if len(full) else np.empty(0, np.int64)
                every = len(FEATURES)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(np.arange(every, dtype=np.int32)), pa.nulls(len(full), pa.int32())]),
                        pa.concat_arrays([pa.nulls(every, part.schema.field(0).type), part.column(0).take(pa.array(full))]),
                        pa.array(np.concatenate([has.sum(0), of_text])),
                    ],
                    names=["feature", key, "n"],
                )

    return texts.mapInArrow(run, f"feature int, `{key}` {_type(texts, key)}, n long")


def roles(texts: DataFrame, key: str, weights: Weights) -> DataFrame:
    """key, line, pos, text, role: every unit of texts ``with_known``, with its role on its text's best path."""
    names = pa.array([*weights.roles, None], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights, sorted({f for f, _ in weights.emission}))
        for batch in batches:
            for part in slices(batch, 1):
                found = Units(part.column(1), LATEST)
                has = Present(model, found.off, KINDS, found.kind, FEATURES, found.features(part.column(2)))
                path = best_paths(has.scores(model), found.off, model.s, model.t)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(found.text)),
                        pa.array(found.line.astype(np.int32)),
                        pa.array(found.pos.astype(np.int32)),
                        found.of_forms([u.text for u in found.forms], pa.string()),
                        names.take(pa.array(np.where(path < 0, len(names) - 1, path))),
                    ],
                    names=[key, "line", "pos", "text", "role"],
                )

    return texts.mapInArrow(run, f"`{key}` {_type(texts, key)}, line int, pos int, text string, role string")


#: Roles and weights for headers of info texts, set by hand.
WEIGHTS = Weights(
    roles=("ARTIST", "CONNECTOR", "MEMBER", "VENUE", "PLACE", "DATE", "SOURCE", "TRACK", "OTHER"),
    allowed={"seg": ("ARTIST", "CONNECTOR", "MEMBER", "VENUE", "PLACE", "SOURCE", "OTHER"), "date": ("DATE",), "track": ("TRACK", "OTHER")},
    needs={"CONNECTOR": "connector_word"},
    bias={"CONNECTOR": 1.0, "MEMBER": -1.0, "PLACE": -1.0, "SOURCE": -2.0, "VENUE": -1.0},
    emission={
        ("line0", "ARTIST"): 2.0, ("lib_artist", "ARTIST"): 3.0, ("lib_artist", "MEMBER"): 2.5, ("lib_venue", "VENUE"): 4.0,
        ("prev_is_connector", "MEMBER"): 2.0, ("connector_word", "CONNECTOR"): 4.0, ("label_source", "SOURCE"): 4.0, ("source_kw", "SOURCE"): 2.5,
        ("has_gt", "SOURCE"): 2.0, ("line1", "VENUE"): 1.0, ("line1", "PLACE"): 1.0, ("after_first", "PLACE"): 1.5, ("first_in_line", "PLACE"): -2.0,
        ("numbered_track", "TRACK"): 3.0, ("line_late", "OTHER"): 1.0, ("block_later", "ARTIST"): -2.0, ("line2_3", "ARTIST"): -2.0, ("starts_lower", "ARTIST"): -2.0, ("starts_lower", "OTHER"): 2.0, ("venue_word", "VENUE"): 2.0,
    },
    start={"ARTIST": 1.0},
    transition={("ARTIST", "CONNECTOR"): 1.0, ("CONNECTOR", "MEMBER"): 3.0, ("VENUE", "PLACE"): 2.0, ("PLACE", "PLACE"): 1.0, ("TRACK", "TRACK"): 0.5, ("MEMBER", "VENUE"): 1.0},
)


def info_texts(c: Catalogue) -> DataFrame:
    """id, body: header, date, source and tracks of each show, as a taper would write them."""
    shows = c.table("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("act"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") % 7 + 1).alias("guest"),
        F.date_format("o_orderdate", "MMMM d, yyyy").alias("day"),
    )
    acts = c.table("customer").select(F.col("c_custkey").alias("act"), F.regexp_replace("c_name", "[^A-Za-z0-9]", " ").alias("name"))
    venues = c.venue.select("id", "name", "city", "state")
    # guests and venues are the first seven of their tables, however many rows these have
    guests = acts.filter(F.col("act").between(1, 7)).select(F.col("act").alias("guest"), F.col("name").alias("second"))
    halls = venues.filter(F.col("id").between(1, 7)).select(F.col("id").alias("venue_id"), F.col("name").alias("hall"), "city", "state")
    shows = shows.join(acts, "act").join(F.broadcast(guests), "guest", "left")
    shows = shows.withColumn("venue_id", F.col("id") % 7 + 1).join(F.broadcast(halls), "venue_id")
    body = F.concat(
        F.col("name"), F.when(F.col("second").isNotNull(), F.concat(F.lit(" with "), F.col("second"))).otherwise(""), F.lit("\n"),
        F.regexp_replace("hall", "[^A-Za-z0-9]", " "), F.lit(", "), F.col("city"), F.lit(", "), F.col("state"), F.lit("\n"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("seeded "), F.col("day"))).otherwise(F.col("day")), F.lit("\n\nSource: SBD > DAT > FLAC\n\n"),
        F.lit("01 opening song\n02. Second song\n"), F.when(F.col("id") % 5 == 0, "\nThanks to the taper who kept all of these for so long").otherwise(""),
    )
    return shows.select("id", body.alias("body"))


def _known(c: Catalogue) -> DataFrame:
    acts = c.table("customer").select(F.regexp_replace("c_name", "[^A-Za-z0-9]", " ").alias("name"))
    return with_known(info_texts(c), "id", "body", acts, c.venue.select("name"))


def feature_counts(c: Catalogue) -> DataFrame:
    """How many units and texts have each feature."""
    rows = feature_rows(_known(c), "id")
    # rows of one text are one text
    rows = rows.groupBy("feature", "id").agg(F.sum("n").alias("n"), F.bit_or("n").alias("bits"))
    has = [F.struct(F.lit(f).alias("feature"), F.coalesce(F.sum(F.when(F.col("feature") == i, F.col("n"))), F.lit(0)).alias("n_units"), F.count_if(F.col("feature").isNull() & (F.getbit("bits", F.lit(i)) == 1)).alias("n_texts")) for i, f in enumerate(FEATURES)]
    return rows.agg(F.array(*has).alias("x")).select(F.inline("x")).filter("n_units > 0")


def decoded_roles(c: Catalogue) -> DataFrame:
    """The role of every unit."""
    return roles(_known(c), "id", WEIGHTS)
