"""Skipping files of the packet table: a trigram index for payload search, a zone map for lookups.

Both are small tables beside the packet table, built by one aggregation each
with partial results per task:

* grams: per file, a table of ``GRAM_BITS`` bits.  Every three characters in a row of a text
  payload set the bit of their hash.  A file without all bits of a literal's trigrams can't hold the
  literal, so a ``LIKE`` search does not read it.
* zones: per file, its least and largest ``index``.  Scattered ids are brought together with the files
  that may hold them by cells of the index range, and only those files are read.

The driver holds lists of file names only, as Spark's own listing does.  An index answers for the files it was built from;
files that came later are always read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PACKET_SCHEMA
from ..sources import storage

GRAM_BITS = 65_536            # bits a file: 8 KB
CELLS_PER_FILE = 4


def trigrams(text: str) -> list[str]:
    """Every three characters in a row of a literal."""
    return sorted({text[i:i + 3] for i in range(len(text) - 2)})


def literals(pattern: str) -> list[str]:
    """The literal runs of a LIKE pattern; a backslash escapes the next character."""
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            run += pattern[i]
        elif c in "%_":
            runs.append(run)
            run = ""
        else:
            run += c
        i += 1
    return [r for r in [*runs, run] if r]


def _bit(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BITS))


def _word(bit: Column) -> Column:
    return F.call_function("div", bit, F.lit(64)).cast("int")


def gram_table(rows: DataFrame, text: str = "payload_utf8") -> DataFrame:
    """(file, word, bits) of a DataFrame that reads files: which trigrams each file's texts hold.

    A task reduces its rows to at most ``GRAM_BITS`` / 64 words a file before anything is shuffled.
    """
    grams = rows.select(F.col("_metadata.file_path").alias("file"),
                        F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))).alias("gram"))
    bit = grams.select("file", _bit(F.col("gram")).alias("bit"))
    return (bit.select("file", _word(F.col("bit")).alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits"))
            .groupBy("file", "word").agg(F.bit_or("bits").alias("bits")))


def zone_table(rows: DataFrame, key: str = "index") -> DataFrame:
    """(file, least, largest, n) of a DataFrame that reads files."""
    return (rows.select(F.col("_metadata.file_path").alias("file"), F.col(key).alias("k")).groupBy("file")
            .agg(F.min("k").alias("least"), F.max("k").alias("largest"), F.count(F.lit(1)).alias("n")))


class FileIndex:
    """The packet table at ``path`` with its grams and zones, kept under ``index_path``."""

    def __init__(self, spark: SparkSession, path: str, index_path: str):
        self.spark, self.path, self.index_path = spark, path, index_path.rstrip("/")

    def build(self) -> FileIndex:
        rows = self._read(None)
        gram_table(rows).repartition("file").sortWithinPartitions("file", "word").write.mode("overwrite").parquet(f"{self.index_path}/grams")
        zone_table(rows).write.mode("overwrite").parquet(f"{self.index_path}/zones")
        return self

    def built(self) -> bool:
        return storage.exists(self.spark, f"{self.index_path}/zones/_SUCCESS")

    def grams(self) -> DataFrame:
        return self.spark.read.schema("file string, word int, bits bigint").parquet(f"{self.index_path}/grams")

    def zones(self) -> DataFrame:
        return self.spark.read.schema("file string, least bigint, largest bigint, n bigint").parquet(f"{self.index_path}/zones")

    def _read(self, files: list[str] | None) -> DataFrame:
        reader = self.spark.read.schema(PACKET_SCHEMA)
        if files is None:
            return reader.parquet(self.path)
        return reader.parquet(*files) if files else self.spark.createDataFrame([], PACKET_SCHEMA)

    def _with_new(self, chosen: set[str]) -> list[str] | None:
        """The chosen files and those that the index does not know; None if that is every file."""
        every = set(self._read(None).inputFiles())
        known = {r["file"] for r in self.zones().select("file").collect()}
        # Listing and metadata write the scheme's slashes differently.
        plain = lambda f: re.sub(r"^file:/+", "/", f)
        wanted, seen = {plain(f) for f in chosen}, {plain(f) for f in known}
        out = sorted(f for f in every if plain(f) in wanted or plain(f) not in seen)
        return None if len(out) == len(every) else out

    # ---------------------------------------------------------------- payload search
    def files_holding(self, patterns: list[str]) -> list[str] | None:
        """Files that may hold a text like one of ``patterns``; None: every file."""
        asked = []
        for i, pattern in enumerate(patterns):
            grams = sorted({g for run in literals(pattern) for g in trigrams(run)})
            if not grams:
                return None                     # too short for the index: every file may hold it
            asked += [(i, g) for g in grams]
        words = (self.spark.createDataFrame(asked, "pattern int, gram string").withColumn("bit", _bit(F.col("gram")))
                 .select("pattern", _word(F.col("bit")).alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("want"))
                 .groupBy("pattern", "word").agg(F.bit_or("want").alias("want")))
        # One row a word of a few literals: bounded by the patterns' length.
        wanted = words.groupBy("pattern").agg(F.count(F.lit(1)).alias("needed")).join(words, "pattern")
        hit = (self.grams().join(F.broadcast(wanted), "word").where(F.col("bits").bitwiseAND(F.col("want")) == F.col("want"))
               .groupBy("file", "pattern").agg(F.count(F.lit(1)).alias("held"), F.first("needed").alias("needed"))
               .where("held = needed").select("file").distinct())
        return self._with_new({r["file"] for r in hit.collect()})

    def search(self, patterns: list[str], also: Column | str | None = None, text: str = "payload_utf8") -> DataFrame:
        """Packets whose ``text`` is LIKE one of ``patterns`` and that meet ``also``, from the files that may hold any."""
        like = F.lit(False)
        for pattern in patterns:
            like = like | F.col(text).like(pattern)
        rows = self._read(self.files_holding(patterns)).filter(like)
        return rows if also is None else rows.filter(also)

    # ---------------------------------------------------------------- lookup of many ids
    def files_with(self, ids: DataFrame, id_col: str = "index") -> list[str] | None:
        """Files whose index range holds one of the ids at least."""
        zones = self.zones()
        whole = zones.agg(F.min("least").alias("least"), F.max("largest").alias("largest"), F.count(F.lit(1)).alias("files")).first()
        if not whole["files"]:
            return None
        width = max(1, (whole["largest"] - whole["least"] + 1) // (CELLS_PER_FILE * whole["files"]))
        cell = lambda c: F.call_function("div", c - F.lit(whole["least"]), F.lit(width))
        keys = (ids.select(F.col(id_col).cast("bigint").alias("id"))
                .where((F.col("id") >= whole["least"]) & (F.col("id") <= whole["largest"])).distinct().withColumn("cell", cell(F.col("id"))))
        spread = zones.withColumn("cell", F.explode(F.sequence(cell(F.col("least")), cell(F.col("largest")))))
        hit = keys.join(spread, "cell").where((F.col("id") >= F.col("least")) & (F.col("id") <= F.col("largest"))).select("file").distinct()
        return self._with_new({r["file"] for r in hit.collect()})

    def lookup(self, ids: DataFrame, id_col: str = "index") -> DataFrame:
        """The packets with the ids, from the files that may hold any."""
        from .query import lookup_many

        return lookup_many(self._read(self.files_with(ids, id_col)), ids, id_col)
