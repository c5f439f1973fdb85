"""Session helpers: table loading, the shared scratch folder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_local_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (any path that Spark's readers can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, shared by driver and executors.

    It is what the cluster names in ``spark.checkpoint.dir``. Only a single-JVM session (``local[...]``)
    without that setting gets a temporary folder of its own; a cluster without it is refused, because
    a machine-local folder is invisible to other executors.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sedge-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local_roots[app] = f"file://{path}"
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below :func:`scratch_root`, grouped by application so that leftovers can be swept."""
    return f"{scratch_root(spark)}/sedge-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared scratch folder and read it back.

    The lineage ends at replicated files rather than at executor memory, so a lost executor costs only
    its running tasks. As the reread table has a known size, Spark broadcasts it only when it is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, for columns of one's own beside them."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with a column ``name``: 0, 1, 2 ... in an order that is total. Ranges are sorted apart and shifted by the counts before them, so no task sees all rows."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a partition
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    return ranged.join(F.broadcast(before), "_range").withColumn(name, place.cast("long")).drop("_range", "_before")  # as many rows as shuffle partitions


def sweep(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it after results have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/sedge-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
