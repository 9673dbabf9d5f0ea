"""Readers and writers of files beside the catalogue's tables.

Text formats use Spark's own readers; bytes that need a guess at their encoding are read as binary
files and decoded in Arrow batches, a file a row; archives are a data source.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.archives import register

GAZETTEER = "id long, name string, ascii_name string, alternates string, latitude double, longitude double, class string, code string, country string, admin1 string, population long"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse give a row of nulls."""
    return spark.read.schema(schema).json(path)


def corpus(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Fixtures of one JSON file each, with the text of the sibling .txt file as info_text (null if there is none)."""
    stem = F.regexp_extract(F.input_file_name(), "([^/]+)\\.[^./]+$", 1)
    heads = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*.json").withColumn("stem", stem)
    texts = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.col("value").alias("info_text"), stem.alias("stem"))
    return heads.join(texts, "stem", "left").drop("stem")


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated places; quotes are ordinary characters, blanks are null."""
    return spark.read.schema(GAZETTEER).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(path)


def reference_csv(spark: SparkSession, path: str) -> DataFrame:
    """A reference table with a header: every column a trimmed string, blanks null, repeated rows once."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    return rows.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in rows.columns)).distinct()


#: The file of a replaced table's folder that names the version in force.
POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and paths in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version below path, then point to it by one rename: readers see the old rows or the new ones, never half of them, never none.

    The version before stays, for readers that have begun on it; older ones are deleted.
    """
    spark = df.sparkSession
    fs, where = _files(spark, path)
    before = _version(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    beside = where(f"{path}/.{version}")
    out = fs.create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    java = spark.sparkContext._gateway
    rename = getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = java.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    folder = fs.makeQualified(where(path)).toUri()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder, spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(beside), fs.makeQualified(where(f"{path}/{POINTER}")), options)
    for status in fs.listStatus(where(path)):
        if status.isDirectory() and status.getPath().getName() not in (version, before):
            fs.delete(status.getPath(), True)


def _version(spark: SparkSession, path: str) -> str | None:
    fs, where = _files(spark, path)
    pointer = where(f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return None
    return spark.read.text(pointer.toString()).first()[0]


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that ``replace_table`` writes."""
    version = _version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no table has been written to {path}")
    return spark.read.parquet(f"{path}/{version}")


def decode_text(data: bytes | None) -> str | None:
    """Bytes as text: by their mark of order, else UTF-8, else the Western code page."""
    if data is None:
        return None
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(encoding, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file below a folder that is not empty."""

    def run(batches):
        for batch in batches:
            texts = [decode_text(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", "content").mapInArrow(run, "path string, text string")


def show_folders(spark: SparkSession, path: str, audio: tuple[str, ...] = ("flac", "mp3")) -> DataFrame:
    """folder, n_audio, n_other, bytes: the folders below a path that hold audio; a disc's folder (disc 1, cd2) counts to its show."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    folder = F.regexp_replace(F.regexp_replace("path", "/[^/]*$", ""), "(?i)/(disc|cd)\\s*[0-9]+$", "")
    is_audio = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1)).isin(*audio)
    out = rows.groupBy(folder.alias("folder")).agg(F.count_if(is_audio).alias("n_audio"), F.count_if(~is_audio).alias("n_other"), F.sum("length").alias("bytes"))
    return out.filter("n_audio > 0")


def tar_json(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """line: the JSON lines of the members named ``entity`` in one .tar.xz dump, read as a stream whatever its size."""
    register(spark)
    folder, _, name = path.rpartition("/")
    return spark.read.format("archive_dump").option("entity", entity).option("only", name).load(folder or ".").select("line")
