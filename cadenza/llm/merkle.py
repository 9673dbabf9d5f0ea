"""Merkle manifest of a dataset: one tree a group of rows, and one over the groups' subroots.

Every step is a DataFrame level.  Rows are dealt by range and numbered with row_number
inside a range plus the rows of the ranges before, so that no task numbers a whole tree.
The index divided by the fanout names a run; a run's sorted children, hashed, are a node
of the next level.  On the way back, each level's runs are joined with the path of the
node they became, and every child gets its run's other children in front of it.  A level
is joined once, and has an eighth of the rows of the one below, so all joins together
carry little more than the lowest one.

Edge cases: a null field is ``-``; null ids come first, and their rows are never
tampered with; rows that repeat an id are leaves of their own, in the order of their hash;
a null group is a tree of its own, the first; one leaf alone is its own subroot; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import read, written

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a node of a path adds to a hash: the run's digests before and after it, as hex text.
STEP = "struct<left: string, right: string>"


def leaf_hash(*values: Column) -> Column:
    """SHA-256 (lower-case hex) of the values, each ``-`` if null, else its UTF-8 length, a colon, and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings on a path as text, from the leaf to the root, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ...) with idx, their place in their tree by ``order``, and n, the tree's rows."""
    rows = written(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), "leaves")
    counts = rows.groupBy("tree", "part").agg(F.count("*").alias("own"))
    tree = Window.partitionBy("tree")
    before = F.sum("own").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("tree", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("own").over(tree).alias("n"))
    place = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    return rows.join(counts, ["tree", "part"]).withColumn("idx", F.col("before") + place - 1).drop("part", "before")


class Forest:
    """The trees over rows (tree, hash, and ``carried`` columns) in ``order``; levels[l] has a row a run of level l."""

    def __init__(self, rows: DataFrame, order: list[str], carried: tuple[str, ...] = (), fanout: int = FANOUT):
        self.carried = carried
        nodes, self.levels, self.tops = numbered(rows, order), [], None
        while True:
            child = F.struct("idx", "hash", *(carried if not self.levels else ()))
            runs = nodes.groupBy("tree", F.expr(f"idx div {fanout}").alias("run")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(child)).alias("children"))
            runs = written(runs, "level")
            top = runs.filter("n = 1").select("tree", F.lit(len(self.levels)).alias("height"), F.col("children")[0]["hash"].alias("top"))
            self.levels.append(runs)
            self.tops = top if self.tops is None else self.tops.unionByName(top)
            more = runs.filter("n > 1")
            if more.isEmpty():
                return
            parent = F.sha2(F.array_join("children.hash", ""), 256)
            nodes = more.select("tree", F.col("run").alias("idx"), F.ceil(F.col("n") / F.lit(float(fanout))).alias("n"), parent.alias("hash"))

    def paths(self, crowns: DataFrame) -> DataFrame:
        """tree, hash, carried columns, path and the columns of ``crowns`` (tree, height, path above the top, ...) of every leaf."""
        extra = [c for c in crowns.columns if c not in ("tree", "height", "path")]
        above = None
        for height in range(len(self.levels) - 1, -1, -1):
            own = crowns.filter(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("run"), "path", *extra)
            above = own if above is None else above.unionByName(own)
            runs = self.levels[height].join(above, ["tree", "run"]).select("tree", "n", "path", *extra, F.col("children.hash").alias("all"), F.posexplode("children").alias("i", "child"))
            left, right = (F.array_join(F.expr(x), "") for x in ("slice(`all`, 1, i)", "slice(`all`, i + 2, size(`all`))"))
            step = F.array(F.struct(left.alias("left"), right.alias("right")))
            path = F.when(F.col("n") > 1, F.concat(step, "path")).otherwise(F.col("path"))
            leaf = ["child.hash", *(f"child.{c}" for c in self.carried)] if height == 0 else []
            above = runs.select("tree", F.col("child.idx").alias("run"), path.alias("path"), *extra, *leaf)
        return above.drop("run")


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, carried: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """order, leaf, subroot, root, path (an array of STEP, from the leaf up) and ``carried`` columns: a row per row of docs.

    Trees are by ``group``; a tree's leaves ascend by ``order``, null first, then by leaf.
    """
    carried = carried or {}
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    own = tuple(carried)
    rows = docs.select(key.alias("tree"), F.col(order).alias("ordered"), leaf_hash(*(F.col(f) for f in fields)).alias("hash"), *(carried[c].alias(c) for c in own))
    trees = Forest(rows, ["ordered", "hash"], ("ordered", *own), fanout)
    # the tree of all trees' subroots
    tops = trees.tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("height").alias("of_height"), F.col("top").alias("hash"))
    crown = Forest(tops, ["of"], ("of", "of_height"), fanout)
    root = crown.tops.select("tree", "height", F.col("top").alias("root"), F.expr(f"cast(array() AS array<{STEP}>)").alias("path"))
    subroots = crown.paths(root).select(F.col("of").alias("tree"), F.col("of_height").alias("height"), "path", F.col("hash").alias("subroot"), "root")
    found = trees.paths(subroots)
    return found.select(F.col("ordered").alias(order), F.col("hash").alias("leaf"), "subroot", "root", "path", *own)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = leaf_hash(*(F.translate("text", ascii_uppercase, ascii_lowercase) if f == "text" else F.col(f) for f in FIELDS))
    found = manifest(read(spark, sf_dir, "documents"), carried={"forged": F.when(tampered, changed)})
    folded = fold(F.coalesce("forged", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_LEVELS = 8


def _oracle() -> str:
    """All levels written out: trees of up to fanout ** _LEVELS leaves."""
    enc = "coalesce(strlen(cast({0} AS varchar)) || ':' || cast({0} AS varchar), '-')"
    leaf = "sha256(" + " || ".join(enc.format(f) for f in FIELDS) + ")"
    forged = leaf.replace("cast(text AS varchar)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    codes = "list_transform(string_split(cast(doc_id AS varchar), ''), lambda d: cast(ascii(d) AS bigint))"
    crc = f"xor(list_reduce(list_prepend(cast(4294967295 AS bigint), {codes}), lambda c, b: {step}), 4294967295)"
    sql = [
        f"WITH raw AS (SELECT doc_id, lang, {leaf} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {forged} END AS forged FROM documents)",
        "l AS MATERIALIZED (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM raw)",
        "a0 AS MATERIALIZED (SELECT lang, i, n, leaf AS h FROM l)",
    ]
    up = "SELECT {0}, i // 8 AS i, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {1}{2} GROUP BY ALL"
    sql += [f"a{k + 1} AS MATERIALIZED ({up.format('lang', 'a', k)})" for k in range(_LEVELS)]
    sql += [f"b0 AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM a{_LEVELS})"]
    sql += [f"b{k + 1} AS MATERIALIZED ({up.replace('{0}, ', '').format('', 'b', k)})" for k in range(_LEVELS)]
    # a leaf's sides at every level, or null where its tree has one node left
    sql += ["p0 AS MATERIALIZED (SELECT l.*, b0.i AS bi, b0.h AS subroot, '' AS proof, coalesce(forged, leaf) AS f FROM l JOIN b0 ON l.lang IS NOT DISTINCT FROM b0.lang)"]
    for k in range(2 * _LEVELS):
        own, mine, level = ("a", "p.i", k) if k < _LEVELS else ("b", "p.bi", k - _LEVELS)
        at = f"({mine} // {8**level})"
        match = "p.lang IS NOT DISTINCT FROM x.lang AND " if own == "a" else ""
        sides = [f"coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i {op} {at}), '')" for op in "<>"]
        sql += [
            f"p{k + 1} AS MATERIALIZED (SELECT doc_id, lang, leaf, r, i, bi, subroot, proof || lt || rt AS proof, CASE WHEN n = 1 THEN f ELSE sha256(lt || f || rt) END AS f FROM "
            f"(SELECT p.doc_id, p.lang, p.leaf, p.r, p.i, p.bi, p.subroot, p.proof, p.f, any_value(x.n) AS n, {sides[0]} AS lt, {sides[1]} AS rt "
            f"FROM p{k} p JOIN {own}{level} x ON {match}x.i // 8 = {at} // 8 GROUP BY ALL))"
        ]
    end = f"SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM p{2 * _LEVELS}, b{_LEVELS}"
    return ", ".join(sql) + " " + end


OP12_SQL = _oracle()
