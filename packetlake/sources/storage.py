"""Paths on the cluster's file system (whatever Hadoop file system a path names)."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

# Parquet codec of the tables that hold payloads: texts take little more than half of what Snappy leaves.
PAYLOAD_CODEC = "zstd"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def fingerprint(spark: SparkSession, paths: list[str], extra: str = "") -> str:
    """A short key that changes when any file under the paths changes, comes or goes."""
    h = hashlib.sha1(extra.encode())
    for path in paths:
        fs, p = _fs(spark, path)
        files, found = fs.listFiles(p, True), []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
        h.update("\n".join(sorted(found)).encode())
    return h.hexdigest()[:16]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: temp name, then rename over the old one.

    The rename replaces the old file: a reader finds the old or the new text at
    any time.  The temp name starts with ``_``, which Spark's file readers skip, so a
    crash between the two steps leaves nothing a reader would pick up.
    """
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    folder, name = path.rsplit("/", 1)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{folder}/_{name}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    files = jvm.org.apache.hadoop.fs
    rename = getattr(files, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(tmp), fs.makeQualified(p), how)


def read_text(spark: SparkSession, path: str) -> str | None:
    """Contents of a small file, or None if it does not exist."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    jvm = spark.sparkContext._jvm
    buf = jvm.java.io.ByteArrayOutputStream()
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(p), buf, 65536, True)
    return bytes(buf.toByteArray()).decode("utf-8")


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def rename(spark: SparkSession, src: str, dst: str) -> bool:
    """Move ``src`` to ``dst``; False if ``dst`` exists already (someone else won)."""
    fs, s = _fs(spark, src)
    _, d = _fs(spark, dst)
    if fs.exists(d):
        return False
    return bool(fs.rename(s, d))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)
