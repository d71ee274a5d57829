"""Session helpers: shared working folder, written intermediates, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few narrow columns is broadcast (about 50 MB at most).
BROADCAST_ROWS = 1_000_000

_local: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_written() -> None:
    """Intermediates go when the driver ends; what a lost driver leaves is named by stage and a random id."""
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone
            return


def build_session(name: str = "viewloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators assume (AQE, UTC, Arrow)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where a session has none (tests, local runs) a temporary folder is made and removed at exit.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _local[app] = tempfile.mkdtemp(prefix="viewloom-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return "file://" + _local[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str = "stage", file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back; ``file_rows``: rows of a file at most (0: any number).

    Cuts the lineage, is columnar (later readers prune columns), and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing will read it again (a state whose successor is written)."""
    spark, path = df.sparkSession, df._written_at
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.remove((spark, path))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when at most ``max_rows`` rows are counted; otherwise leave it to AQE.

    The count stops at ``max_rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
