"""What the operators of this subpackage share: tables, shared storage, text pieces."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Removes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folder: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the corpus folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of
    the session. Only where it is unset and all run in one process (tests, one machine) a
    temporary one; on a cluster that would be another folder on each machine: RuntimeError."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/quillstone-{app}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="quillstone-")
    return f"file://{_own_folder[app]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: cuts the lineage, survives
    lost executors, and is computed once however often it is read. Its shuffle files go
    as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete all tables that ``settled`` wrote for this application. Results that
    are not yet written or collected can't be read any more afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names`` with as many underscores before them that no column of ``taken`` is called so in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"))), F.lit(0)).cast("long")


def blocks_for(spark: SparkSession, df: DataFrame, mb_each: float, at_least: int = 1) -> int:
    """How many blocks of about ``mb_each`` MB of input files ``df`` makes: from
    the optimizer's size of the plan, which costs no job."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(at_least, min(1_000_000, math.ceil(size / (mb_each * 1e6))))
