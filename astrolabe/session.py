"""Session helpers: one place for the Spark settings every job here relies on.

Library functions never create a session themselves; they take DataFrames.
These helpers exist for tests, ``bench.py`` and command-line use.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter at scale, not only locally:
#  * AQE re-plans joins from runtime sizes, coalesces small shuffle partitions
#    and splits skewed ones (one key may hold a third of the rows).
#  * The broadcast threshold stays at Spark's default; every explicit
#    broadcast in this package is guarded by a row-count check instead.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # reliable checkpoints are deleted once their DataFrame is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "astrolabe", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("ASTROLABE_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read; it must
    be set there.  Only on a local master a fresh folder is created when it isn't.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        try:
            if spark.sparkContext.getCheckpointDir() is None:
                spark.sparkContext.setCheckpointDir(current)
        except Exception:  # Spark Connect has no SparkContext
            pass
        return current
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="astrolabe-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    try:
        spark.sparkContext.setCheckpointDir(local)
    except Exception:
        pass
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder, deleted when the application ends."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    except Exception:  # Spark Connect has no JVM access: the folder's owner cleans up
        pass
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table of :func:`scratch_path` that nothing reads any more."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # Spark Connect has no JVM access: the folder's owner cleans up
        pass


#: Whether a job's shuffle files are deleted as soon as it has ended; else that waits for the driver's garbage collection.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within, a written table leaves no shuffle files behind."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``astrolabe`` importable in the Python workers (once per application).

    Kernels run inside ``mapInPandas`` / ``applyInPandas`` on the executors,
    which import this package by name; the driver zips its ``.py`` files and
    registers the archive with ``addPyFile`` (``addArtifacts`` on Spark
    Connect), the programmatic form of ``--py-files``.
    """
    import zipfile

    try:
        key = spark.sparkContext.applicationId
    except Exception:
        key = f"connect-{id(spark)}"
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="astrolabe-pyfiles-"), "astrolabe.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    zf.write(full, os.path.relpath(full, root))
    try:
        spark.sparkContext.addPyFile(out)
    except Exception:
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(key)
