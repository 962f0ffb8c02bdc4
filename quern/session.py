"""Session defaults shared by tests, the bench and interactive use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quern") -> SparkSession:
    """A local session with the settings the library's results rely on (UTC, ANSI casts, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session, wherever they run."""
    context = spark.sparkContext
    if any(name.endswith("/quern.zip") for name in context.listFiles):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and go on from there.

    The folder is the session's ``spark.checkpoint.dir``. A folder of our own is set only where none is
    configured and all runs on this machine, as in tests; a cluster without one is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "quern-checkpoints"))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under the cluster's shared checkpoint folder."""
    stored(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def unsized(df: DataFrame) -> DataFrame:
    """``df``, which should be cut, without its size estimate, for tables that a loop joins again and again.

    A cut keeps the estimate of the plan before it. A join's estimate is the product of its sides', so in a
    loop its digits grow exponentially, and planning never ends. Spark measures the true sizes as it runs.
    """
    session, plan = df.sparkSession, df._jdf.queryExecution()
    return DataFrame(session._jsparkSession.internalCreateDataFrame(plan.toRdd(), df._jdf.schema(), False), session)


@contextmanager
def shelf() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that runs a frame once and goes on from its rows, which stay on the executors' disks until the block ends.

    Rows of a lost executor are made again, so a frame must come out the same each time: ids by place, and what
    outlives the block, are ``stored``; so is what took large shuffles, as those stay with held rows. Unlike there, a task writes no file of the shared folder; on a local one
    without Hadoop's native library each such file starts two processes.
    """
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.DISK_ONLY))
        df.count()
        return unsized(df)

    try:
        yield hold
    finally:
        for df in held:
            df.unpersist()
