"""Catalogue views over the star-schema tables.

Each view is a deterministic projection, so scans stay column-pruned.  The same
views as SQL are in ``cadenza.plans.views``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalogue:
    """Lazy views of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def n_venues(self) -> Column:
        """Rows of supplier, one at least: a scalar subquery, so that a plan can be built without a job."""
        return self.table("supplier").agg(F.greatest(F.count("*"), F.lit(1)).alias("n")).scalar()

    @property
    def genre(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))

    @property
    def artist(self) -> DataFrame:
        rows = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("X "), F.col("c_name"))).alias("sort_name"),
            F.col("n_regionkey").alias("genre_id"),
        )

    @property
    def venue(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        rows = self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        return rows.select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("City "), (F.col("s_suppkey") % 17).cast("string")).alias("city"),
            F.col("n_name").alias("state"),
            F.col("r_name").alias("country"),
        )

    @property
    def performance(self) -> DataFrame:
        key = F.col("o_orderkey")
        month = F.when(key % 7 != 0, F.month("o_orderdate"))
        return self.table("orders").select(
            key.alias("id"),
            F.col("o_custkey").alias("artist_id"),
            F.when(key % 11 != 0, key % self.n_venues()).alias("venue_id"),
            F.year("o_orderdate").alias("y"),
            month.alias("m"),
            F.when(month.isNotNull() & (key % 5 != 0), F.dayofmonth("o_orderdate")).alias("d"),
            F.when(key % 11 == 0, F.lit("Elsewhere")).alias("city"),
        )

    @property
    def recording(self) -> DataFrame:
        """(order, line) is not unique in lineitem; the smallest values of a pair stand for it."""
        rows = self.table("lineitem").groupBy("l_orderkey", "l_linenumber")
        rows = rows.agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"), F.min("l_discount").alias("discount"), F.min("l_shipdate").alias("created_at"))
        flag, line = F.col("flag"), F.col("l_linenumber")
        return rows.select(
            (F.col("l_orderkey") * 10 + line).alias("id"),
            F.col("l_orderkey").alias("performance_id"),
            F.when(flag == "A", "SBD").when(flag == "N", "FM").otherwise("AUD").alias("source"),
            F.when(F.col("status") == "F", "library").otherwise("queue").alias("location"),
            F.when(line == 7, "studio").otherwise("live").alias("kind"),
            F.when(F.col("discount") < 0.03, "A").when(F.col("discount") < 0.07, "B").otherwise("C").alias("quality"),
            ((line == 3) & (F.col("l_orderkey") % 13 == 0)).alias("is_favorite"),
            (line == 5).alias("is_official"),
            "created_at",
        )

    @property
    def membership(self) -> DataFrame:
        """Stints of a musician with an act, as yyyymmdd."""
        day = lambda c: F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)
        rows = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.groupBy(F.col("o_custkey").alias("artist_id"), F.col("l_suppkey").alias("musician_id")).agg(
            day(F.min("l_shipdate")).alias("start_day"), day(F.max("l_shipdate")).alias("end_day")
        )

    @property
    def track(self) -> DataFrame:
        rows = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        line = F.col("l_linenumber")
        return rows.select(
            (F.col("l_orderkey") * 10 + line).alias("recording_id"),
            F.col("l_partkey").alias("track_number"),
            F.when(line % 3 != 0, line % 3).alias("set_number"),
            F.col("p_name").alias("title"),
            (F.col("l_quantity") * 10).alias("duration"),
            (F.col("l_extendedprice") / 1e5).alias("flatness"),
        )
