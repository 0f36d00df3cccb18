"""Tables by name, and intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table of keys that is broadcast: some 64 MB as a hash table of two numbers a row, which the driver holds too.
FEW_ROWS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's spark.checkpoint.dir. Only a session on one machine may leave it unset and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="vitrine-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/vitrine-{label}-{uuid.uuid4().hex}"
    system, jvm_path = _hadoop(spark, path)
    system.deleteOnExit(jvm_path)
    return path


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as parquet in the shared folder and read it back: lineage ends there.

    Unlike a local checkpoint the rows outlive any executor, and what follows may read them
    several times without computing them again. The table stays until the driver ends; see Scratch for those that needn't.
    """
    return _write(df, shared_path(df.sparkSession, label))


def few(written: DataFrame, most: int | None = None) -> DataFrame:
    """A written table of a few short columns, to be broadcast where it meets another if it has at most `most` rows (FEW_ROWS), and else to be sorted and merged with it.

    The planner goes by the files' size: it only learns of few rows when it has shuffled the other table, and takes millions of numbers, which compress to a byte or two each, for a small table.
    """
    return F.broadcast(written) if written.count() <= (FEW_ROWS if most is None else most) else written.hint("merge")


def sweep(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go. They stay as long as the driver's JVM holds their plans, which it only notices when it collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Written tables of one operator, removed when its block ends. What the operator returns must be materialized by then."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """As materialize(), until the block ends."""
        self.paths.append(shared_path(self.spark, label))
        return _write(df, self.paths[-1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            system, jvm_path = _hadoop(self.spark, path)
            system.delete(jvm_path, True)
        self.paths.clear()


def fresh(columns: list[str], name: str) -> str:
    """`name`, or with underscores after it until no column is called so, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Give this package to the session's workers, unless they find it themselves: in the driver's working folder or on PYTHONPATH."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if Path.cwd() == root or str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(context, "_vitrine_shipped", False):
        return
    package = shutil.make_archive(f"{tempfile.mkdtemp()}/vitrine-package", "zip", root, "vitrine")
    context.addPyFile(package)  # the driver serves it
    context._vitrine_shipped = True
