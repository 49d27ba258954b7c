"""Papers as a stream: each new file is one row, so parsing and extraction are stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import content_lines, marker
from ..operators.extract import items as all_items
from ..operators.parse import markdown_sections
from ..sources.readers import _stem, fewer_tasks


def paper_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_idx, paper_id, text); doc_idx is a hash of the path, since a stream has no order."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    files = files.where(F.lower("path").rlike(r"\.(md|txt)$"))
    return files.select(F.xxhash64("path").alias("doc_idx"), _stem(F.col("path")).alias("paper_id"), F.decode("content", "UTF-8").alias("text"))


def marked_lines(docs: DataFrame) -> DataFrame:
    """(paper_id, section, line) of marked lines; narrow, for batches and streams alike."""
    rows = markdown_sections(docs).select("paper_id", F.col("title").alias("section"), F.explode(content_lines(F.col("text"))).alias("line"))
    return rows.where(marker(F.col("line")).isNotNull())


def write_items(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Items of each micro-batch of whole papers, written exactly once by batch number."""

    def save(batch: DataFrame, n: int) -> None:
        sections = markdown_sections(fewer_tasks(batch)).persist()  # items read them more than once
        try:
            all_items(sections).write.mode("overwrite").parquet(f"{out}/batch={n}")
        finally:
            sections.unpersist()

    return docs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
