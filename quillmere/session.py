"""Session helper and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "quillmere", **conf) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary
    folder: on a cluster a machine-local folder is lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="quillmere-")
    return f"{base.rstrip('/')}/quillmere/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Delete what this application has written to its shared folder.  Call it
    at the end of a run, when no frame that reads from there is needed."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        Folder(spark, f"{base.rstrip('/')}/quillmere/{spark.sparkContext.applicationId}").delete()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan is cut
    there and a lost executor costs a re-read, not a re-computation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Folder:
    """Small marker files in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}" if name else path)
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def touch(self, name: str) -> None:
        self._fs.create(self._path(name), True).close()

    def names(self, name: str = "") -> list[str]:
        """What lies in the folder; nothing if it is not there."""
        place = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def delete(self) -> None:
        self._fs.delete(self._path(""), True)


SMALL_BYTES = 256 << 20


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, the one its broadcast choice uses."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def setting_bytes(spark: SparkSession, name: str) -> int:
    """A byte-size setting such as 10485760b or 10MB as a number."""
    text = spark.conf.get(name).strip().lower()
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    digits = text.rstrip("bkmgt")
    unit = text[len(digits):].rstrip("b")
    return int(digits) << units.get(unit, 0)


def spread_small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """Deal the rows of a small table over all cores before costly per-row
    work: a small Parquet file is one row group and so one task.  A large
    table has splits enough and is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if planned_bytes(df) <= limit else df
