"""Archives as data sources: dumps and pages of listings, read in batches or as streams, and a connector over their items.

A folder's files are taken in the order of their names, a partition each; the offset of a stream is the
last name that was read, so that a restart reads what came later and nothing twice.  A dump is read as
a stream of lines and never held whole, however large.
"""

from __future__ import annotations

import json
import lzma
import posixpath
import tarfile
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def names(folder: str, ending: str) -> list[str]:
    """Files of a folder by name; a folder that is not there has none."""
    from pyarrow import fs

    store, path = _store(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(posixpath.basename(f.path) for f in found if f.is_file and f.path.endswith(ending))


class File(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _Read:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str], ending: str, rows: Callable[[object, str, dict[str, str]], Iterator[tuple]]):
        self.options, self.ending, self.rows = options, ending, rows
        if "path" not in options:
            raise ValueError("the folder is to be given as path")

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # a folder without files
            return
        store, path = _store(self.options["path"])
        with store.open_input_stream(posixpath.join(path, partition.name), compression=None) as file:
            yield from self.rows(file, partition.name, self.options)


class _Batch(_Read, DataSourceReader):
    def partitions(self) -> list[File]:
        only = self.options.get("only")
        return [File(n) for n in names(self.options["path"], self.ending) if only in (None, n)]


class _Stream(_Read, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(names(self.options["path"], self.ending), default="")}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(n) for n in names(self.options["path"], self.ending) if start["last"] < n <= end["last"]]

    def commit(self, end: dict) -> None:
        """Files stay; the checkpoint holds the offset."""


def _dump_lines(file, name: str, options: dict[str, str]) -> Iterator[tuple]:
    """JSON lines of the members called ``entity`` (all members without that option), numbered in each member."""
    entity = options.get("entity")
    with lzma.open(file) as plain, tarfile.open(fileobj=plain, mode="r|") as dump:
        for member in dump:
            if not member.isfile() or entity and posixpath.basename(member.name) != entity:
                continue
            for number, line in enumerate(dump.extractfile(member)):
                if (text := line.strip()).startswith(b"{"):
                    yield name, member.name, number, text.decode("utf-8", "replace")


def _page_items(file, name: str, options: dict[str, str]) -> Iterator[tuple]:
    """The items of one page of a listing, as JSON; a page that is no JSON has none."""
    try:
        page = json.loads(file.read())
    except ValueError:
        return
    for number, item in enumerate(page.get("items") or [] if isinstance(page, dict) else []):
        yield name, number, json.dumps(item)


class DumpSource(DataSource):
    """Lines of .tar.xz dumps; options path, entity, and only (one file of the folder)."""

    @classmethod
    def name(cls) -> str:
        return "archive_dump"

    def schema(self) -> str:
        return "archive string, member string, number long, line string"

    def reader(self, schema) -> _Batch:
        return _Batch(dict(self.options), ".tar.xz", _dump_lines)

    def streamReader(self, schema) -> _Stream:
        return _Stream(dict(self.options), ".tar.xz", _dump_lines)


class PageSource(DataSource):
    """Items of a listing's pages, files of JSON; option path."""

    @classmethod
    def name(cls) -> str:
        return "archive_pages"

    def schema(self) -> str:
        return "page string, number int, item string"

    def reader(self, schema) -> _Batch:
        return _Batch(dict(self.options), ".json", _page_items)

    def streamReader(self, schema) -> _Stream:
        return _Stream(dict(self.options), ".json", _page_items)


def register(spark: SparkSession) -> None:
    for source in (DumpSource, PageSource):
        spark.dataSource.register(source)


class Listings:
    """Listings kept for some seconds: what is asked for again is read again only when it is old."""

    def __init__(self, seconds: float = 300, most: int = 500, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self.kept: dict[tuple, tuple[float, DataFrame]] = {}

    def get(self, key: tuple, load: Callable[[], DataFrame]) -> DataFrame:
        now = self.clock()
        if key in self.kept and self.kept[key][0] > now:
            return self.kept[key][1]
        for old in [k for k, (until, _) in self.kept.items() if until <= now or k == key or len(self.kept) >= self.most]:
            self.kept.pop(old)[1].unpersist()
        found = load().persist()
        self.kept[key] = (now + self.seconds, found)
        return found


# The columns that a listing can be sorted by, what tells a source, and the formats of sound.
SORTS = {"newest": ("added", False), "oldest": ("added", True), "date": ("date", False), "title": ("title", True), "downloads": ("downloads", False)}
SOURCES = {"MTX": "mtx matrix", "SBD": "sbd soundboard", "FM": "fm", "AUD": "aud audience"}
SOURCE_TEXTS = {"MTX": "mtx matrix", "SBD": "sbd soundboard board", "FM": "fm broadcast radio", "AUD": "aud audience"}
SOUND = "flac shn mp3 ogg wav m4a ape".split()
LOSSLESS = ["flac", "shn"]
#: Characters that mean something in the archive's query language.
SPECIAL = r'([+\-&|!(){}\[\]^"~*?:\\/])'


def source_type(identifier: Column, text: Column) -> Column:
    """MTX, SBD, FM or AUD: a word of the identifier says it, else a word of the text; in that order, as a matrix's text names what it is made of."""
    inside = F.split(F.lower(F.coalesce(identifier, F.lit(""))), "[^a-z0-9]+")
    said = F.lower(F.coalesce(text, F.lit("")))
    by_name = [F.when(F.arrays_overlap(inside, F.array(*map(F.lit, words.split()))), label) for label, words in SOURCES.items()]
    by_text = [F.when(said.rlike(rf"\b({words.replace(' ', '|')})\b"), label) for label, words in SOURCE_TEXTS.items()]
    return F.coalesce(*by_name, *by_text)


def compiled_query(typed: Column) -> Column:
    """Typed words as the archive's query: words joined by AND and escaped, a year, month or day as the range of its days."""
    range_ = lambda a, b: F.concat(F.lit("date:["), a, F.lit(" TO "), b, F.lit("]"))

    def term(word: Column) -> Column:
        month = F.concat(word, F.lit("-01")).try_cast("date")
        return (
            F.when(word.rlike(r"^(19|20)\d\d$"), range_(F.concat(word, F.lit("-01-01")), F.concat(word, F.lit("-12-31"))))
            .when(word.rlike(r"^(19|20)\d\d-\d\d$") & month.isNotNull(), range_(month.cast("string"), F.last_day(month).cast("string")))
            .when(word.rlike(r"^(19|20)\d\d-\d\d-\d\d$") & word.try_cast("date").isNotNull(), range_(word, word))
            .otherwise(F.regexp_replace(word, SPECIAL, r"\\$1"))
        )

    words = F.filter(F.split(F.trim(typed), r"\s+"), lambda w: w != "")
    return F.nullif(F.array_join(F.transform(words, term), " AND "), F.lit(""))


class Archive:
    """A connector over items (id, title, artist, date as text, added, downloads) and files (id, name, format, size, md5, original, private)."""

    def __init__(self, items: DataFrame, files: DataFrame, page_rows: int = 50):
        self.items, self.files, self.page_rows = items, files, page_rows

    def _page(self, rows: DataFrame, page: int, sort: str) -> DataFrame:
        """One page and whether there are more (``more``); unknown sorts are newest."""
        column, ascending = SORTS.get(sort, SORTS["newest"])
        order = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
        begin = (max(1, page) - 1) * self.page_rows
        # one row beyond the page tells whether another page follows
        listed = rows.orderBy(order, "id").offset(begin).limit(self.page_rows + 1)
        total = listed.agg(F.count("*").alias("n"))
        return listed.orderBy(order, "id").limit(self.page_rows).crossJoin(F.broadcast(total)).withColumn("more", F.col("n") > self.page_rows).drop("n")

    def recent(self, page: int = 1, sort: str = "newest") -> DataFrame:
        return self._page(self.items, page, sort)

    def search(self, typed: str, page: int = 1, sort: str = "newest") -> DataFrame:
        """Items whose title or artist holds every word, and whose date begins as a typed year, month or day."""
        found = self.items
        for word in (typed or "").lower().split():
            number = word.replace("-", "")
            if number.isdigit() and len(word) in (4, 7, 10) and word[:2] in ("19", "20"):
                # bounds on the column itself, which reach the scan
                found = found.filter((F.col("date") >= word) & (F.col("date") < word + "~"))
            else:
                found = found.filter(F.lower("title").contains(word) | F.lower("artist").contains(word))
        return self._page(found, page, sort)

    def item(self, of: str) -> DataFrame:
        """The item with its public original files, by name."""
        files = self.files.filter((F.col("id") == of) & F.col("original") & ~F.col("private"))
        listed = files.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("name", "format", "size"))).alias("files"))
        return self.items.filter(F.col("id") == of).join(listed, "id", "left")

    def download_plan(self) -> DataFrame:
        """id, name, size, md5: the files worth fetching of every item: public originals that are text, or sound of the item's best kind."""
        ending = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))
        rows = self.files.filter(F.col("original") & ~F.col("private")).withColumn("ending", ending)
        rank = F.when(F.col("ending") == "flac", 0).when(F.col("ending") == "shn", 1).when(F.col("ending").isin(*SOUND), 2)
        best = rows.withColumn("rank", rank).groupBy("id").agg(F.min("rank").alias("best"))
        rows = rows.withColumn("rank", rank).join(best, "id")
        return rows.filter((F.col("ending") == "txt") | (F.col("rank") == F.col("best"))).select("id", "name", "size", "md5")
