"""Watching a folder: new files become passages as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chunking, cleaning, index
from lectern.sources import corpus, formats

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watched(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream of (path, modified, size, content, file_hash)."""
    rows = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("file_hash"))


def index_after(passages: DataFrame, path: str, no: int) -> None:
    """The index below ``path`` with new passages (pid, domain, source, title, text, page), saved as the version of batch ``no``.

    A batch that is run again starts from the version before it, so nothing is counted twice."""
    spark = passages.sparkSession
    before = index.load(spark, f"{path}/{no - 1}", index.VERSION, None, str(no - 1)) if no else None
    new = index.updated(before, passages) if before else index.build(passages)
    index.save(new, f"{path}/{no}", index.VERSION, None, str(no))


def import_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True, interval: str = "10 seconds", index_path: str | None = None):
    """Writes passages (path, file_hash, page, chunk, text) of files whose hash has not come in the day before; with ``once`` what is there, else for good.

    The batch number is part of the path, so a batch that is run again overwrites itself.  With ``index_path`` the index there is brought up to date after each batch."""

    def batch(df: DataFrame, no: int) -> None:
        df = df.persist()
        texts = formats.extracted(df).join(df.select("path", "file_hash"), "path")
        chunking.chunks(cleaning.cleaned(texts), ["path", "file_hash", "page"], "cleaned").write.mode("overwrite").parquet(f"{out}/batch={no}")
        df.unpersist()
        if index_path:
            rows = spark.read.schema("path string, file_hash string, page int, chunk int, text string").parquet(f"{out}/batch={no}")
            title = F.element_at(F.split("path", "/"), -1)
            index_after(rows.select(F.xxhash64("file_hash", "page", "chunk").alias("pid"), corpus.domain_of("path").alias("domain"), F.col("path").alias("source"), title.alias("title"), "text", "page"), index_path, no)

    stream = watched(spark, folder).withWatermark("modified", "1 day").dropDuplicatesWithinWatermark(["file_hash"])
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
