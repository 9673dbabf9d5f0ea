"""What the operators share: reading, shared storage, vocabulary files, column names."""

from __future__ import annotations

import base64
import os
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies lie when the package that ships them cannot be imported.
VOCABULARY_DIR = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Place of a vocabulary file; ``folder`` overrides the installed package."""
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = VOCABULARY_DIR
    return os.path.join(folder, name)


@lru_cache(maxsize=None)
def byte_bpe(folder: str | None = None):
    """The byte-level vocabulary as a rank encoder, special strings handled as the JSON file's default.

    It returns the ids that ``tokenizers`` gives for byte_bpe_50k.json (tests
    compare them) at about a quarter of the time.
    """
    import public_tokenizers
    import tiktoken

    ranks = {
        base64.b64decode(a): int(b)
        for a, b in map(bytes.split, open(vocabulary_path("byte_bpe_50k.tiktoken", folder), "rb"))
    }
    return tiktoken.Encoding(
        "byte_bpe_50k",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=ranks,
        special_tokens={"<|endoftext|>": 50256},
    )


def encode(text: str | None, folder: str | None = None):
    """Ids (numpy uint32) of one whole text."""
    return byte_bpe(folder).encode_to_numpy(text or "", allowed_special="all")


#: Rows and bytes of an Arrow batch: what a Python worker holds at once, but for one longer text.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as texts can be long."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if int(spark.conf.get(key).rstrip("b")) > most:
            spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local default only where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = os.path.join(tempfile.gettempdir(), "cadenza-shared")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/cadenza/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(nullable(df.schema)).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "written_path", None):
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Bits of a sieve: 4096 bitmaps of 4 KB, so 16 MB at most, whatever the input.
SIEVE_BITS = 27


def _bit(column: str):
    return F.pmod(F.xxhash64(column), F.lit(1 << SIEVE_BITS))


def sieve(values: DataFrame) -> DataFrame:
    """bucket, bits: bitmaps with the hashed bit of every value of the only column of ``values``."""
    at = _bit(values.columns[0])
    rows = values.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("pos"))
    return rows.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("pos").alias("bits"))


def sifted(df: DataFrame, column: str, bitmaps: DataFrame, among: bool = True) -> DataFrame:
    """Rows of df whose ``column`` may be one of a sieve's values, or the other rows, which surely are not.

    The first are a superset that an exact join follows; only they are shuffled for it.  A sieve
    of far more than 2**SIEVE_BITS values passes nearly all rows, and the join then does the work alone.
    """
    bucket, bits = fresh(df, "bucket"), fresh(df, "bits")
    at = _bit(column)
    held = F.broadcast(bitmaps.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))
    pos = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.bit_get(byte, (pos % 8).cast("int")) == 1, F.lit(False))
    rows = df.withColumn(bucket, F.bitmap_bucket_number(at)).join(held, bucket, "left")
    return rows.filter(hit if among else ~hit).select(*df.columns)


def without(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows of df whose ``column`` is none of ``values`` (one column of that name); rows with a null stay."""
    bitmaps = sieve(values)
    maybe = sifted(df, column, bitmaps).join(values, column, "left_anti").select(*df.columns)
    return sifted(df, column, bitmaps, among=False).unionByName(maybe)
