"""Similarity of names by common blocks, and a join on it that compares few pairs.

The similarity of two names is twice the letters in their common blocks over all letters; the
blocks are the longest common one, the first of equal ones, and those left and right of it in turn.
It cannot exceed what the two lengths allow, nor what the letters allow that both have, whatever their
order.  Names of n letters together that reach a cutoff c have c * n / 2 letters in at most (1 - c) * n + 1
blocks, for blocks are parted by letters that are in none; so they share a number of letters, and one of
three-letter runs, that follows from n.  Of as many letters or runs as must be shared, the rarest few
cannot all be missing: an equality join on those finds every pair, and only what passes
the bound by letters is compared in full.

Letters in common blocks stand in the same order in both names.  Where few letters of either name may be
left out, the names that remain in all ways of leaving them out are joined instead, by their hashes: names by chance
never meet there, so the rows of that join grow with the names and not with their square.  Long names have too many ways
(``MOST_WAYS``) and go by letters and runs.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matching(a: str, b: str) -> int:
    """Letters in the common blocks of a and b."""
    where: dict[str, list[int]] = {}
    for j, letter in enumerate(b):
        where.setdefault(letter, []).append(j)
    total, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        a_lo, a_hi, b_lo, b_hi = open_.pop()
        best, at, to = 0, 0, 0
        ending: dict[int, int] = {}  # length of the common block that ends at a[i], b[j]
        for i in range(a_lo, a_hi):
            now = {}
            for j in where.get(a[i], ()):
                if b_lo <= j < b_hi:
                    now[j] = n = ending.get(j - 1, 0) + 1
                    if n > best:
                        best, at, to = n, i - n + 1, j - n + 1
            ending = now
        if best:
            total += best
            open_ += [(a_lo, at, b_lo, to), (at + best, a_hi, to + best, b_hi)]
    return total


def ratio(a: str, b: str) -> float:
    return 2 * matching(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two text columns, null where one is."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@lru_cache(100_000)
def reaches(a: str, b: str, cutoff: float) -> bool:
    """Whether two names' similarity reaches the cutoff: equality and the bound by lengths first."""
    return a == b or (2 * min(len(a), len(b)) / (len(a) + len(b)) >= cutoff and ratio(a, b) >= cutoff)


def alike(a: Column, b: Column, cutoff: float) -> Column:
    """Whether the similarity of two text columns reaches the cutoff, null where one is."""

    @F.pandas_udf(T.BooleanType())
    def compared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else reaches(x, y, cutoff) for x, y in zip(a, b)], dtype="object")

    return compared(a, b)


#: Ways of leaving letters out of a name, at most, for it to be joined by them.
MOST_WAYS = 1000


def ways(n: Column, kept: Column) -> Column:
    """In how many ways ``kept`` of n letters can be kept."""
    left = n - kept
    steps = F.when(left > 0, F.sequence(F.lit(1), F.greatest(left, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(1.0), lambda x, i: x * (kept + i) / i)


@F.pandas_udf(T.ArrayType(T.LongType()))
def kept_hashes(names: pd.Series, kept: pd.Series) -> pd.Series:
    """Hashes of what is left of a name in every way of keeping that many letters."""
    out: list = [None] * len(names)
    with np.errstate(over="ignore"):
        for (n, k), at in names.groupby([names.str.len(), kept]).indices.items():
            which = np.array(list(combinations(range(int(n)), int(k))), np.int64)
            weights = np.multiply.accumulate(np.full(int(k), 0xD1342543DE82EF95, np.uint64))
            chunk = max(1, 2_000_000 // which.size)
            for i in range(0, len(at), chunk):
                rows = at[i : i + chunk]
                letters = np.frombuffer("".join(names.iloc[rows]).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(len(rows), -1)
                letters = (letters + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                letters = (letters ^ (letters >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                letters ^= letters >> np.uint64(32)
                sums = (letters[:, which] * weights).sum(2) + np.uint64(k)
                for row, hashes in zip(rows, sums.view(np.int64)):
                    out[row] = hashes
    return pd.Series(out, dtype="object")


def numbered(parts: Column) -> Column:
    """The parts of a text, each with how many of it stand before: a bag as a set."""
    parts = F.sort_array(parts)
    # sorted, equal parts stand together, and the first of them tells each one's number
    return F.transform(parts, lambda c, i: F.concat(c, F.lit("\u0001"), (i + 1 - F.array_position(parts, c)).cast("string")))


def _parts(names: DataFrame) -> DataFrame:
    letters = F.filter(F.split("name", ""), lambda c: c != "")
    runs = F.when(F.col("n") > 2, F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - 2, F.lit(1))), lambda i: F.substring(F.col("name"), i, F.lit(3))))
    return names.withColumn("letters", numbered(letters)).withColumn("runs", F.coalesce(numbered(runs), F.array().cast("array<string>")))


def close_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """a, b, ratio: the pairs of the distinct texts ``name`` of both tables whose similarity reaches the cutoff.

    Null and empty names are close to nothing.  No pair is lost: the filters are upper bounds.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("cutoff must lie above 0 and at most 1")
    share = cutoff / (2 - cutoff)
    plain = [t.select("name").filter("name <> ''").distinct().withColumn("n", F.length("name")) for t in (left, right)]
    # pairs of lengths that there are and that can reach the cutoff, and how many letters such names share at least
    lengths = plain[0].select("n").distinct().join(F.broadcast(plain[1].select(F.col("n").alias("m")).distinct()), (F.col("m") >= F.ceil(F.col("n") * share - 1e-9)) & (F.col("m") <= F.floor(F.col("n") / share + 1e-9)))
    lengths = lengths.withColumn("kept", F.ceil((F.col("n") + F.col("m")) * (cutoff / 2) - 1e-9)).filter(F.col("kept") <= F.least("n", "m"))
    few = lambda n, m, kept: F.greatest(ways(n, kept), ways(m, kept)) <= MOST_WAYS
    lengths = lengths.withColumn("few", few(F.col("n"), F.col("m"), F.col("kept")))
    sides = [lengths.select("n", "kept", "few"), lengths.select(F.col("m").alias("n"), "kept", "few")]
    # a name gives many hashes: names are dealt to all tasks, however small they are as rows
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = []
    for t, side in zip(plain, sides):
        rows = t.repartition(parts, "name").join(F.broadcast(side.filter("few").select("n", "kept").distinct()), "n").select(F.xxhash64("name").alias("of"), kept_hashes("name", "kept").alias("x"))
        hashed.append(rows.select("of", F.explode(F.array_distinct("x")).alias("x")))
    near = hashed[0].withColumnRenamed("of", "a_of").join(hashed[1].withColumnRenamed("of", "b_of"), "x").select("a_of", "b_of").distinct()
    for t, c in zip(plain, "ab"):
        near = near.join(t.select(F.xxhash64("name").alias(f"{c}_of"), F.col("name").alias(c)), f"{c}_of")
    near = near.select("a", "b")

    # the others, by letters and runs
    tables = [_parts(t.join(F.broadcast(side.filter("NOT few").select("n").distinct()), "n", "left_semi")) for t, side in zip(plain, sides)]
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("marks")) for k in ("letters", "runs"))))
    marks = [t.select("name", "n", kinds.alias("k")).select("name", "n", "k.kind", F.size("k.marks").alias("size"), F.explode("k.marks").alias("mark")) for t in tables]
    counts = marks[0].unionByName(marks[1]).groupBy("kind", "mark").agg(F.count("*").alias("names"))
    rank = F.row_number().over(Window.partitionBy("name", "kind").orderBy("names", "mark"))
    marks = [m.join(counts, ["kind", "mark"]).withColumn("rank", rank) for m in marks]

    def least(kind: Column, both: Column) -> Column:
        """How many letters or runs names of ``both`` letters together share at least."""
        letters = F.ceil(both * (cutoff / 2) - 1e-9)
        return F.when(kind == "letters", letters).otherwise(letters - 2 * (F.floor(both - 2 * letters) + 1))

    kind, shortest = F.col("kind"), F.col("n") + F.ceil(F.col("n") * share - 1e-9)
    a = marks[0].withColumn("m", F.explode(F.sequence(F.ceil(F.col("n") * share - 1e-9), F.floor(F.col("n") / share + 1e-9))))
    both = F.col("n") + F.col("m")
    a = a.filter(~few(F.col("n"), F.col("m"), least(F.lit("letters"), both)))
    # runs where some must be shared, letters for short names
    use = F.when(least(F.lit("runs"), both) >= 1, "runs").otherwise("letters")
    a = a.filter((kind == use) & (F.col("rank") <= F.col("size") - least(kind, both) + 1))
    b = marks[1].filter((least(kind, shortest) >= 1) | (kind == "runs")).filter(F.col("rank") <= F.col("size") - F.greatest(least(kind, shortest), F.lit(1)) + 1)
    b = b.select(F.col("name").alias("b"), F.col("n").cast("long").alias("m"), "kind", "mark")
    pairs = a.select(F.col("name").alias("a"), "m", "kind", "mark").join(b, ["m", "kind", "mark"]).select("a", "b").distinct()
    for t, c in zip(tables, "ab"):
        pairs = pairs.join(t.select(F.col("name").alias(c), F.col("letters").alias(f"{c}_letters")), c)
    common = F.size(F.array_intersect("a_letters", "b_letters"))
    pairs = pairs.filter(2 * common >= cutoff * (F.size("a_letters") + F.size("b_letters")) - 1e-9).select("a", "b")
    return pairs.unionByName(near).distinct().withColumn("ratio", block_ratio("a", "b")).filter(F.col("ratio") >= cutoff)


def closest(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """a, b, ratio: the closest name of ``right`` for each name of ``left``; of equally close ones the last in order."""
    asked, known = left.select("name").filter("name <> ''").distinct(), right.select("name").distinct()
    same = asked.join(known, "name")
    rest = close_pairs(asked.join(known, "name", "left_anti"), known, cutoff).groupBy("a").agg(F.max(F.struct("ratio", "b")).alias("x"))
    return same.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("ratio")).unionByName(rest.select("a", "x.b", "x.ratio"))
