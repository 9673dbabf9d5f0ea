"""Names of recordings by template, features of their signals, and the streams of their plays as batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.signals import signal_features
from cadenza.functions.templates import Template
from cadenza.sources.catalogue import Catalogue
from cadenza.streaming import offers

FIELDS = ["artist", "year", "month", "day", "city", "source", "disc", "track", "title"]
FOLDER = "{artist:title} {year}[-{month:pad2}[-{day:pad2}]][ ({city})][ {source:lower}]"


def folder_names(c: Catalogue) -> DataFrame:
    """The folder of each show, and what is read back from its name."""
    key = F.col("o_orderkey")
    rows = c.table("orders").join(c.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    columns = {
        "artist": F.translate(F.lower("c_name"), "#", " "),
        "year": F.year("o_orderdate"),
        "month": F.when(key % 7 > 0, F.month("o_orderdate")),
        "day": F.when(key % 5 > 0, F.dayofmonth("o_orderdate")),
        "city": F.when(key % 3 == 0, F.concat(F.lit("City: "), F.col("c_nationkey"))).when(key % 3 == 1, " "),
        "source": F.when(key % 2 == 0, "SBD"),
    }
    template = Template(FOLDER, FIELDS)
    named = rows.select("o_orderkey", template.render(columns).alias("name"))
    read = template.parse(F.col("name"))
    return named.select("o_orderkey", "name", *(read[f].alias(f) for f in ("artist", "year", "month", "day", "city", "source")))


def vector_signals(c: Catalogue) -> DataFrame:
    """Each embedding taken as a signal: levels, crest, zero crossings and the share of clipped samples."""
    found = signal_features(c.table("embeddings"), "vec_id", "embedding")
    return found.select("vec_id", "n", *(F.round(f, 6).alias(f) for f in ("rms_db", "peak_db", "crest_db", "clipped_share", "dc_offset")), "zero_crossings", "n_clips")


def play_sessions(c: Catalogue) -> DataFrame:
    return offers.sessions(c.table("events"))


def returned_offers(c: Catalogue) -> DataFrame:
    return offers.returned(c.table("events"))
