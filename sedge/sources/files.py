"""Text files as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sedge.functions.text import front_matter_of, json_merge, line_count, title, word_count

PATTERN = "*.{md,markdown,txt}"


def decode(content: Column) -> Column:
    """Bytes as text: UTF-8 where valid, else Latin-1; line ends become newlines."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def document_id(source: Column) -> Column:
    """A deterministic id, so that files read again are the same documents."""
    return F.sha2(source, 256)


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, source (relative to the folder) and content of all text files below a folder, in order of path. A folder that has none, or is not there, gives no rows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return as_texts(spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary"), folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PATTERN).load(folder)
    return as_texts(files, folder).orderBy("path")


def as_texts(files: DataFrame, folder: str) -> DataFrame:
    base = folder.split("://", 1)[-1].rstrip("/") + "/"
    source = F.regexp_replace(F.col("path"), r"^.*?" + base.replace("\\", "\\\\").replace(".", r"\."), "")
    return files.select("path", source.alias("source"), decode(F.col("content")).alias("content"), F.col("modificationTime").alias("modified"))


def as_documents(texts: DataFrame) -> DataFrame:
    """id, title, source, content, metadata (JSON) and created_at of (path, source, content, modified)."""
    facts = F.to_json(F.struct(F.col("path").alias("file_path"), F.length("content").alias("file_size")))
    counts = F.to_json(F.struct(line_count(F.col("content")).alias("line_count"), word_count(F.col("content")).alias("word_count")))
    head = F.coalesce(front_matter_of(F.col("content")), F.lit("{}"))
    metadata = json_merge(json_merge(facts, head), counts)
    return texts.select(document_id(F.col("source")).alias("id"), title(F.col("content"), F.col("path")).alias("title"), "source", "content", metadata.alias("metadata"), F.col("modified").alias("created_at"), F.col("modified").alias("updated_at"))
