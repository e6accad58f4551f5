"""Pages that arrive as files, parsed once each: Structured Streaming from Parquet to Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagelens.operators.parse import parsed_pages
from pagelens.session import prepare

PAGES = "page_id long, url string, html string"


def read_pages(spark: SparkSession, path: str, files_at_once: int = 1000, schema: str = PAGES) -> DataFrame:
    return prepare(spark).readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def parse_arriving(spark: SparkSession, source: str, sink: str, checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
    """Parses what has arrived since the last run and stops. Checkpoint and sink belong in shared folders: after a lost driver the
    next run goes on where the last batch was committed, and no page is written twice."""
    parsed = parsed_pages(read_pages(spark, source, files_at_once))
    return parsed.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
