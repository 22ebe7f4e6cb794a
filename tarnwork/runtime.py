"""Session defaults, table reading and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession

_RUN = f"tarnwork-{uuid.uuid4().hex}"
_CLEANUP: set[int] = set()
_SCRATCH: list[list[str]] = []

#: Settings that suit a plain local session; a cluster's own settings win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(*, master: str = "local[*]", app: str = "tarnwork", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session with the defaults of this engine (UTC, adaptive execution, few shuffle partitions)."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", driver_memory).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session, as an archive in the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_tarnwork_shipped", False):
        return
    package, archive = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, Path("tarnwork") / path.relative_to(package))
    target = f"{shared_folder(spark)}/tarnwork.zip"
    write_bytes(spark, target, archive.getvalue())
    context.addPyFile(target)
    context._tarnwork_shipped = True


def ship_active() -> None:
    """`ship` for the session of this thread: functions of columns call it before they use Python on workers."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file through the file system that Spark sees."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's content, through the file system that Spark sees."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Table `name` of a directory that holds one parquet file or folder per table."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`df.mapInArrow` with this package sent to the workers before, so that it works on any caller's table."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors can write: the one the cluster names in `spark.checkpoint.dir`. Only where all of
    Spark runs on one machine (tests) may it be unset; then a temporary folder is taken."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = Path(tempfile.mkdtemp(prefix="tarnwork-checkpoint-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/{_RUN}"
    if id(spark) not in _CLEANUP:
        _CLEANUP.add(id(spark))
        atexit.register(_remove_quietly, spark, folder)
    return folder


def _remove_quietly(spark: SparkSession, folder: str) -> None:
    try:
        remove(spark, folder)
    except Exception:  # the session may be gone at exit
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through the file system that Spark sees."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write `df` to the shared folder and read it back: later plans start from the files, and the loss of
    an executor loses nothing. The files live until `release`, the end of an enclosing `scratch`, or of the process."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    for held in _SCRATCH:
        held.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnwork_path = path
    return out


def cut_lineage_counting(df: DataFrame, tag: str = "cut", **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """`cut_lineage`, and aggregates of the written rows taken while they were written (0 for no rows)."""
    watch = Observation()
    written = cut_lineage(df.observe(watch, *[m.alias(name) for name, m in measures.items()]), tag)
    return written, {name: int(watch.get.get(name) or 0) for name in measures}


def release(*written: DataFrame) -> None:
    """Delete the files of tables that `cut_lineage` gave; no plan may start from them any more."""
    for df in written:
        path = getattr(df, "_tarnwork_path", None)
        if path:
            remove(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written for lineage within it. Write or collect results inside."""
    held: list[str] = []
    _SCRATCH.append(held)
    try:
        yield
    finally:
        _SCRATCH.remove(held)
        for path in held:
            remove(spark, path)
