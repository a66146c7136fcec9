"""Session helpers: checkpoint folder, written tables, table loading."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Without the setting, a local master gets a folder of its own, as in tests; on a cluster
    that is an error, because executors would each write to their own disks."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-ckpt-"))
    return sc.getCheckpointDir()


#: Bytes that a job reads for each file that it writes, where its shuffles have several times as many partitions.
PER_FILE = 8 << 20


def gathered(df: DataFrame) -> DataFrame:
    """``df``, to be written in few files: where a small table was shuffled into very many partitions,
    its rows are dealt out once more, to one task for each ``PER_FILE`` bytes of the files that the job
    reads, or one a core.

    Each file costs the executor that writes it requests to the store, and on local disks two processes:
    Hadoop starts ``chmod`` for the file and for its checksum, and until that runs, the child counts with
    all of the executor's memory. (``coalesce`` would not do: a task holds the sort buffers of all the
    partitions that it reads until it ends.)"""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    read = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    files = max(spark.sparkContext.defaultParallelism, read // PER_FILE)
    return df.repartition(files) if 4 * files <= int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage; survives the loss of executors; columnar, so smaller than
    a row checkpoint."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tidewell-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing that is still to run reads them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage now: Spark deletes the shuffle files of finished jobs
    only when it does, and until then they add to the disk that the next job needs."""
    spark.sparkContext._jvm.System.gc()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
