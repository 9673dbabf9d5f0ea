"""N-gram Jaccard self-join by rare-first prefix filtering; result as components.

1. One pass hashes each whole text to its set of k-word shingles (64 bit), a set
   key, and a parity signature of at least 1024 bits and one bit a shingle; the same pass counts
   shingles in a table of fixed size (2**18 counters), which only sets the order.
   Rows with equal sets are one class from here on.
2. A second pass orders each set rare-first and emits its prefix.  Two sets at or
   above the threshold share a prefix shingle, whatever the order.
3. Prefix shingles are pre-aggregated.  One held by two classes gives their pair at
   once.  Of one held by more, each class first meets two classes of its own size
   band, so candidates grow with the prefixes, not with the square of a group.
   Verified links give components.
4. ``rounds`` more times: of the shingles whose classes still lie in more than one
   component, each class against the first and the last one of its size band in
   ``ends`` hashed orders, where those are of another component.
5. Last, of each such shingle all pairs across components, filtered by length,
   position, suffix and an earlier shingle in common inside the join; a hot shingle is cut
   into a grid of blocks, each cell a group of its own.  Pairs inside a component need no test.
6. Length and position are filtered before a pair is emitted, then the suffix: the
   symmetric difference of two sets is at least the Hamming distance of their
   parity signatures.  What is left is verified on the whole sets, once per pair.

Filters only drop pairs that cannot reach the threshold, so no link between
different texts is lost.  Edge cases: null or blank texts have no shingles and are
linked with nothing; fewer than k words are one shingle of all words; null ids
never name a component unless all its ids are null; repeated rows are one class;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import discard, read, sieve, sifted, written
from cadenza.llm.components import components
from cadenza.llm.textarrays import chunks, window_hash

SKETCH_BITS = 18
_BLOCKS = 64
#: Least bits of a parity signature; larger sets have one bit a shingle or more.
_LEAST_BITS = 1024
#: Shingles before its own that a row of the last join carries.
NEAR = 8
#: Classes of a shingle that meet in one group of the last join.
CELL = 512
LEAST_PERCENT = 50


def _sets(chunk, k: int):
    """The sorted distinct shingle hashes of every document of a chunk."""
    words = chunk.split().word_hash(lower=True)
    at = chunk.windows(k)
    grams = window_hash(words, at, k)
    cut = np.searchsorted(at, chunk.woff)
    for i in range(chunk.n):
        a, b = chunk.woff[i], chunk.woff[i + 1]
        if cut[i] < cut[i + 1]:
            yield np.unique(grams[cut[i] : cut[i + 1]])
        elif a < b:
            yield window_hash(words[a:b], np.array([0]), int(b - a))
        else:
            yield np.empty(0, np.uint64)


def _keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit keys of a set."""
    found = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def _key(shingles: np.ndarray, clashes: frozenset[int]) -> int:
    """The set's key: the first, or the second where different sets share the first."""
    first, second = _keys(shingles)
    return second if first in clashes else first


def _signature(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of 2**j low-bit buckets, packed in 64-bit words; longer ones fold onto shorter."""
    bits = max(_LEAST_BITS, 1 << max(len(shingles) - 1, 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, np.ndarray, frozenset[int]]:
    """(doc_id, n, key, sig) of every row, the table of shingle counts, and the first keys that different sets share.

    Of N sets about N * N / 2**65 first keys clash: none below a billion sets, some tens at 5e10.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n", "key", "key2", "sig", "block", "counts"]
    size = 1 << SKETCH_BITS

    def run(batches):
        total, id_arrow = np.zeros(size, np.int64), None
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for c in chunks(batch.column(1)):
                sets = list(_sets(c, k))
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
                keys = [_keys(s) if len(s) else (None, None) for s in sets]
                sigs = [_signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[c.lo : c.hi],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x for x, _ in keys], pa.int64()),
                        pa.array([x for _, x in keys], pa.int64()),
                        pa.array(sigs, pa.list_(pa.int64())),
                        pa.nulls(c.n, pa.int32()),
                        pa.nulls(c.n, pa.binary()),
                    ],
                    names=names,
                )
        if id_arrow is not None:
            nothing = [pa.nulls(_BLOCKS, t) for t in (id_arrow, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            counts = [b.tobytes() for b in np.split(total, _BLOCKS)]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(range(_BLOCKS), pa.int32()), pa.array(counts, pa.binary())], names=names)

    rows = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, n long, key long, key2 long, sig array<long>, block int, counts binary")
    rows = written(rows.withColumn("part", F.spark_partition_id()), "sets")

    def add(group):
        counts = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
        out = group.slice(0, 1)
        return out.set_column(out.schema.get_field_index("counts"), "counts", pa.array([counts.tobytes()], pa.binary()))

    counts = rows.filter("block IS NOT NULL").select("block", F.expr("part div 256").alias("part"), "counts")
    schema = "block int, part int, counts binary"
    # two levels, so that no task adds up more than 256 blocks of 32 KB at once on the first
    counts = counts.selectExpr("block", "cast(part AS int) part", "counts").groupBy("block", "part").applyInArrow(add, schema)
    counts = counts.groupBy("block").applyInArrow(add, schema)
    table = np.zeros(size, np.int64)
    for r in counts.collect():
        table[r.block * (size // _BLOCKS) :][: size // _BLOCKS] = np.frombuffer(r.counts, np.int64)
    table_path = rows.written_path
    rows = rows.filter("block IS NULL")
    twice = rows.groupBy("key").agg(F.min("key2").alias("x"), F.max("key2").alias("y")).filter("x <> y")
    clashes = frozenset(r.key for r in twice.select("key").collect())
    if clashes:
        rows = rows.withColumn("key", F.when(F.col("key").isin(*clashes), F.col("key2")).otherwise(F.col("key")))
    rows = rows.select("doc_id", "n", "key", "sig")
    rows.written_path = table_path
    return rows, table, clashes


def prefixes(docs: DataFrame, text_col: str, k: int, percent: int, table: np.ndarray, clashes: frozenset[int]) -> DataFrame:
    """key, n, tokens: the rare-first prefix of each distinct set of a partition."""
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        counts, seen = held.value, set()
        for batch in batches:
            out = []
            for c in chunks(batch.column(0)):
                for s in _sets(c, k):
                    n = len(s)
                    if not n or (key := _key(s, clashes)) in seen:
                        continue
                    seen.add(key)
                    order = np.lexsort((s, counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                    out.append((key, n, s[order[: n - -(-percent * n // 100) + 1]].view(np.int64)))
            if out:
                keys, sizes, tokens = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["key", "n", "tokens"]
                )

    return docs.select(text_col).mapInArrow(run, "key long, n long, tokens array<long>")


def _long_enough(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _overlap(a: Column, b: Column, percent: int) -> Column:
    """Least size of the intersection that reaches the threshold."""
    return F.ceil(percent * (a + b) / F.lit(100.0 + percent) - 1e-9)


def _suffix(a: str, b: str, percent: int) -> Column:
    """Suffix filter on columns a.n, a.sig, b.n, b.sig: parity signatures differ in no more bits than the sets in elements."""
    fold = "CASE WHEN size({x}.sig) > size({y}.sig) THEN zip_with(slice({x}.sig, 1, size({y}.sig)), slice({x}.sig, size({y}.sig) + 1, size({y}.sig)), (p, q) -> p ^ q) ELSE {x}.sig END"
    # sizes within the length filter differ by one doubling at most
    x, y = fold.format(x=a, y=b), fold.format(x=b, y=a)
    differ = F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)")
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return differ <= na + nb - 2 * _overlap(na, nb, percent)


def _filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the length and suffix filters."""
    left, right = classes.select("key", "n", "sig").alias("l"), classes.select("key", "n", "sig").alias("r")
    near = _long_enough(F.col("l.n"), F.col("r.n"), percent) & _suffix("l", "r", percent)
    return pairs.join(left, F.col("a") == F.col("l.key")).join(right, (F.col("b") == F.col("r.key")) & near).select("a", "b")


def _whole_sets(docs: DataFrame, id_col: str, text_col: str, k: int, wanted: DataFrame, clashes: frozenset[int]) -> DataFrame:
    """key, shingles (binary) of the wanted classes (key, doc_id); texts without an id are all looked at."""

    def run(batches):
        for batch in batches:
            out = [s for c in chunks(batch.column(0)) for s in _sets(c, k) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_key(s, clashes) for s in out], pa.int64()), pa.array([s.tobytes() for s in out], pa.binary())], names=["key", "shingles"]
            )

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    ids = wanted.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    known = sifted(texts, "doc_id", sieve(ids)).join(ids, "doc_id", "left_semi").select("text")
    sets = known.unionByName(texts.filter("doc_id IS NULL").select("text")).filter("text <> ''").mapInArrow(run, "key long, shingles binary")
    return sets.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets reach the threshold."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b"
    )
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _packed(n: str, pos: str) -> Column:
    """A size and a position in one long, ordered by size first."""
    return F.shiftleft(F.col(n), 32).bitwiseOR(F.col(pos))


def _index(n: Column, percent: int) -> Column:
    """Prefix that the shorter of two sets needs."""
    return n - F.ceil(2 * percent * n / F.lit(100.0 + percent) - 1e-9) + 1


def _near(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Length and positional filter of two sets at a shingle they share: sizes n, positions p in the rare-first order."""
    # matches before the shingle are at most the smaller position, the others at most the shorter rest
    most = F.least(p1, p2) + F.least(n1 - p1, n2 - p2)
    short = F.when(n1 <= n2, p1 < _index(n1, percent)).otherwise(p2 < _index(n2, percent))
    either = (n1 == n2) & (p2 < _index(n2, percent))
    return _long_enough(n1, n2, percent) & (short | either) & (most >= _overlap(n1, n2, percent))


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _band(n: Column, percent: int) -> Column:
    """Sizes in bands: two sets that link lie in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / min(percent, 99)))).cast("int")


def _star_pairs(rows: DataFrame, seed: int, ends: int, percent: int, grouped: bool) -> DataFrame:
    """Each class of a shingle and band against the first and the last class in ``ends`` hashed orders.

    rows: token, key, n, pos, and component if ``grouped``; then only pairs across components.
    """
    parts = ["component"] if grouped else []
    rows = rows.withColumn("band", _band(F.col("n"), percent))
    orders = [F.struct(F.xxhash64("key", F.lit(seed + i)).alias("h"), "key", "n", "pos", *parts) for i in range(ends)]
    few = rows.groupBy("token", "band").agg(*(f(o).alias(f"{f.__name__}{i}") for i, o in enumerate(orders) for f in (F.min, F.max)))
    few = few.select("token", "band", F.array_distinct(F.array(*(F.struct(*(f"{c}.{x}" for x in ("key", "n", "pos", *parts))) for c in few.columns[2:]))).alias("ends"))
    star = rows.join(few, ["token", "band"]).select("key", "n", "pos", *parts, F.explode("ends").alias("e"))
    apart = F.col("key") != F.col("e.key")
    if grouped:
        apart &= F.col("component") != F.col("e.component")
    star = star.filter(apart & _near(F.col("n"), F.col("pos"), F.col("e.n"), F.col("e.pos"), percent))
    return star.select(*_pair(F.col("key"), F.col("e.key")))


def _last_pairs(named: DataFrame, classes: DataFrame, percent: int, cell: int) -> DataFrame:
    """Every pair across components that the filters leave, of rows (token, key, n, pos, component, c).

    A shingle of c classes is cut into blocks of about ``cell`` classes, and each pair of
    blocks is a group of its own, so that no task gets a hot shingle whole.  A pair that shares one
    of the NEAR shingles before is left to that one.
    """
    mine = Window.partitionBy("key").orderBy("pos")
    rows = named.join(classes.select("key", "sig"), "key")
    rows = rows.withColumn("last", F.lag("pos").over(mine)).withColumn("before", F.collect_list("token").over(mine.rowsBetween(-NEAR, -1)))
    rows = rows.filter("last IS NULL OR last <> pos").drop("last")  # a class once a shingle
    rows = rows.withColumn("blocks", F.ceil(F.col("c") / F.lit(float(cell))).cast("int"))
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(key, token), blocks) AS int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks", "c")
    a, b = rows.alias("a"), rows.alias("b")
    # one condition on both sides, so that both read one exchange
    apart = (F.struct("a.block", "b.block") == F.struct("a.i", "b.j")) & (F.col("a.component") != F.col("b.component"))
    apart &= (F.col("a.i") < F.col("a.j")) | (F.col("a.key") < F.col("b.key"))
    near = _near(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"), percent)
    same = [F.col(f"a.{x}") == F.col(f"b.{x}") for x in ("token", "i", "j")]
    on = same[0] & same[1] & same[2] & apart & near & ~F.arrays_overlap("a.before", "b.before") & _suffix("a", "b", percent)
    return a.join(b, on).select(*_pair(F.col("a.key"), F.col("b.key")))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, rounds: int = 1, ends: int = 3, cell: int = CELL
) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per row of docs; links at 100 * both >= percent * either."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must lie in {LEAST_PERCENT} to 100")  # the suffix filter folds one doubling of sizes
    docs = docs.select(id_col, text_col)
    rows, table, clashes = shingle_sets(docs, id_col, text_col, k)
    classes = written(
        rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes"
    )
    kept = written(prefixes(docs, text_col, k, percent, table, clashes), "prefixes")
    tokens = kept.select("key", "n", F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
    # one row a shingle: of two classes it holds the pair whole, so only shingles of more are looked at again
    shared = tokens.withColumn("at", _packed("n", "pos")).groupBy("token")
    shared = shared.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("at").alias("x"), F.max("at").alias("y"), F.count("*").alias("c"))
    shared = written(shared.filter("a <> b"), "shared")
    size, place = (lambda c: F.shiftright(F.col(c), 32)), (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF))
    two = shared.filter((F.col("c") == 2) & _near(size("x"), place("x"), size("y"), place("y"), percent)).select("a", "b")
    many = shared.filter("c > 2").select("token")
    held = written(sifted(tokens, "token", sieve(many)).join(many, "token", "left_semi"), "held")

    ids = classes.select("key", "doc_id")
    tested = links = sets = None
    done = [rows, classes]
    parts = classes.select(F.col("key").alias("node"), F.col("key").alias("component")).limit(0)

    def test(pairs: DataFrame) -> None:
        """Verify the pairs that no round has verified, and join the components anew."""
        nonlocal tested, links, sets, parts
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(_filtered(pairs, classes, percent), "pairs")
        done.append(pairs)
        if pairs.isEmpty():
            return
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(ids, "key")
        if sets is not None:
            wanted = wanted.join(sets.select("key"), "key", "left_anti")
        wanted = written(wanted, "wanted")
        if sets is None or not wanted.isEmpty():
            more = written(_whole_sets(docs, id_col, text_col, k, wanted, clashes), "whole-sets")
            done.append(more)
            sets = more if sets is None else sets.unionByName(more)
        discard(wanted)
        found = written(_links(pairs, sets, percent), "links")
        done.append(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        before, parts = parts, components(links)
        discard(before)

    test(two.unionByName(_star_pairs(held, 0, 1, percent, False)))
    discard(kept, shared)
    rows_of, table_of, named = held, held, None
    for seed in range(rounds + 1):
        # shingles whose classes lie in more than one component
        of = rows_of.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        mixed = of.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c")).filter("x <> y")
        named = written(of.join(mixed.select("token", "c"), "token"), "named")
        discard(table_of)
        rows_of, table_of = named.drop("component", "c"), named
        if seed < rounds:
            test(_star_pairs(named, 1 + seed * ends, ends, percent, True))
    test(_last_pairs(named, classes, percent, cell))
    discard(named)

    whole = ids.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    whole = whole.join(least, "component").select("key", "component_id")
    out = rows.join(whole, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = written(out, "components")
    discard(parts, *done)
    return out


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
