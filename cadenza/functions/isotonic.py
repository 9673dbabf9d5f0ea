"""Isotonic regression of a bounded number of bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def isotonic(bins: DataFrame, order: str, value: str, weight: str, most: int = 1000) -> DataFrame:
    """The bins with ``fitted``: nondecreasing weighted least squares, by pooling adjacent violators.

    Blocks (sum, weight, bins) stand in rising order; a new bin takes in the blocks before it whose mean is not
    below its own.  All bins must fit in one row: more than ``most`` raise an error; no bins give no rows.
    """
    items = F.sort_array(F.collect_list(F.struct(order, value, weight)))
    packed = bins.agg(items.alias("all"), F.count("*").alias("n"))
    packed = packed.select(F.when(F.col("n") <= most, F.col("all")).otherwise(F.raise_error(F.lit("too many bins"))).alias("all")).filter("size(all) > 0")
    block = "struct<s: double, w: double, k: int>"
    none = f"cast(array() AS array<{block}>)"
    new = f"struct(cast(x.{value} * x.{weight} AS double) AS s, cast(x.{weight} AS double) AS w, 1 AS k)"
    pool = f"""aggregate(reverse(stack), struct({new} AS b, {none} AS rest), (t, o) ->
      IF(size(t.rest) = 0 AND o.s * t.b.w >= t.b.s * o.w,
         struct(struct(t.b.s + o.s AS s, t.b.w + o.w AS w, t.b.k + o.k AS k) AS b, t.rest AS rest),
         struct(t.b AS b, concat(t.rest, array(o)) AS rest)),
      t -> concat(reverse(t.rest), array(t.b)))"""
    fitted = f"flatten(transform(aggregate(all, {none}, (stack, x) -> {pool}), b -> array_repeat(b.s / b.w, b.k)))"
    rows = packed.selectExpr("all", f"{fitted} AS fitted").select(F.explode(F.arrays_zip("all", "fitted")).alias("r"))
    return rows.select(f"r.all.{order}", f"r.all.{value}", f"r.all.{weight}", F.round("r.fitted", 9).alias("fitted"))
