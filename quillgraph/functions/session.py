"""Session helpers shared by every operator."""

from __future__ import annotations

import gc
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests, the bench and the smoke query."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillgraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLGRAPH_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; the reader lists and prunes it, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    A folder of this machine is chosen only where none is named and all runs in one process, as in
    tests; on a cluster a missing folder is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="quillgraph-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Rows of an Arrow batch; wide rows of Spark's own default would take much memory on both sides of a worker.
BATCH_ROWS = 2000


def narrow_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of BATCH_ROWS, unless the session has a figure of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def free_name(name: str, columns) -> str:
    """``name``, with underscores before it until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def as_uri(folder: str) -> str:
    """The folder as a URI, for readers that are not Spark's."""
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any store that Spark opens."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, in_loop: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage (survives lost executors).

    A checkpoint keeps the optimizer's estimate of its size, and a join's estimate is the product of
    its sides'. In a loop of joins the digits of that product would double in every round, until
    planning takes minutes; ``in_loop`` forgets the estimate, and joins are chosen when they run.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    done = df.checkpoint(eager=True)
    if not in_loop:
        return done
    rows = done._jdf.queryExecution().logical().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


#: Rows of a few numbers that a task should have at least.
TASK_ROWS = 10_000


def gathered(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` in as few tasks as ``rows`` rows (about) need; never more than it has, and nothing is shuffled.

    Many tables of a round are small beside the input, whose number of shuffle partitions would else
    start a task, and write a file, for every few rows.
    """
    return df.coalesce(max(1, -(-rows // task_rows)))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more.

    The cleaner follows the driver's garbage collection, which a small driver heap may not run for a
    long time; disk on the executors would hold every finished shuffle until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
