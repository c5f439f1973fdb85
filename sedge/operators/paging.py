"""Pages of a total order that are read without those before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sedge.runtime import numbered, own_prefix

#: Pages of a folder.
RANGE = 64


class Pages:
    """Rows written once in an order that is total, by page; a page opens one folder, and there the row groups that hold it."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, prefix: str, size: int, total: int):
        self.spark, self.path, self.schema, self.prefix, self.size, self.total = spark, path, schema, prefix, size, total

    @classmethod
    def write(cls, rows: DataFrame, path: str, *order, size: int = 100) -> Pages:
        """Number the rows in ``order``, range by range, and write them by page. Columns of any name are kept."""
        own = own_prefix(rows)
        n, page, folder = f"{own}n", f"{own}page", f"{own}range"
        placed = numbered(rows, n, *order).withColumn(page, F.floor(F.col(n) / size).cast("long")).withColumn(folder, F.floor(F.col(page) / RANGE).cast("long"))
        placed.repartitionByRange(folder, page).sortWithinPartitions(folder, n).write.partitionBy(folder).option("compression", "zstd").parquet(path)
        return cls(rows.sparkSession, path, placed.schema, own, size, rows.count())

    @property
    def count(self) -> int:
        return -(-self.total // self.size)

    def page(self, number: int) -> DataFrame:
        """The rows of a page, from 0, in order; none beyond the last."""
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        own = self.prefix
        found = rows.where((F.col(f"{own}range") == number // RANGE) & (F.col(f"{own}page") == number)).orderBy(f"{own}n")
        return found.drop(f"{own}n", f"{own}page", f"{own}range")

    def starts(self) -> DataFrame:
        """(page, and the columns of its first row) of all pages, so that a listing can be entered at a key."""
        own = self.prefix
        rows = self.spark.read.schema(self.schema).parquet(self.path).where(F.col(f"{own}n") % self.size == 0)
        return rows.withColumnRenamed(f"{own}page", "page").drop(f"{own}n", f"{own}range")
