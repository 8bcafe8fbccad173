"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Settings every job of the library expects.  Rendering rules format times in
# UTC; AQE re-plans joins and coalesces shuffle partitions at run time.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

# Context settings (fixed when the context starts): checkpoints written by the
# numbering are removed once nothing refers to them any more.
CONTEXT_DEFAULTS = {
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "packetlake",
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session with the library defaults applied."""
    builder = SparkSession.builder.appName(app)
    for key, value in CONTEXT_DEFAULTS.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the library's session settings to an existing session."""
    for key, value in SESSION_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Each query run inside leaves no shuffle files behind: the next one need not find room beside them.

    For jobs that write what they compute and run a DataFrame once; running it again would recompute its shuffles.
    """
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, most_bytes: int) -> Iterator[None]:
    """Python workers get record batches of at most about so many bytes from the jobs run inside; a larger row is a batch of its own."""
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by whoever runs the job (a path every
    executor can reach).  Only a local-mode session without one – tests,
    benchmarks – gets a fresh scratch folder of its own.  ``checkpoint()``
    writes below it (Spark adds a folder per application); tables the library
    writes go to the folder itself.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/").rsplit("/", 1)[0]
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    path = tempfile.mkdtemp(prefix="packetlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``packetlake`` importable by Python workers (once per application).

    Executors unpickle the functions of ``mapInArrow`` by module name; the
    package is zipped and added with ``addPyFile`` – what ``--py-files`` does
    for a submitted job – unless the application already shipped it.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _shipped:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="packetlake-py-"), "packetlake.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.join("packetlake", os.path.relpath(full, pkg_dir)))
    sc.addPyFile(out)
    _shipped.add(app)
