"""One place that builds a session with the settings the engine is tuned for."""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC times and Arrow on; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, as in tests, local mode has one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: build the session with a folder that the driver and all executors share")
        return _own_folder()
    return root if ":" in root else f"file://{root}"


_MADE: list[tuple[SparkSession, str]] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, for what one query writes down; it is removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _remove_all() -> None:
    for spark, path in _MADE:
        try:
            fs, target = _status(spark, path)
            fs.delete(target, True)
        except Exception:  # the session may have ended before
            return


def _status(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, target


def source_version(df: DataFrame, one_by_one: int = 64) -> str:
    """A hash of the names of the files that a DataFrame reads, which Spark has listed, and of their sizes and times.

    Of more than ``one_by_one`` files, the folders are asked instead, one call each: a writer gives new files new names.
    """
    names = sorted(df.inputFiles())
    asked = names if len(names) <= one_by_one else sorted({n.rsplit("/", 1)[0] for n in names})
    parts = list(names)
    for name in asked:
        fs, path = _status(df.sparkSession, name)
        status = fs.getFileStatus(path)
        size = status.getLen() if asked is names else fs.getContentSummary(path).getLength()
        parts.append(f"{size} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:24]


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether a store of several tables is whole: its last table has been committed."""
    fs, target = _status(spark, f"{path}/pages/_SUCCESS")
    return fs.exists(target)
