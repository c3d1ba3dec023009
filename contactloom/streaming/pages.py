"""Pages that arrive as files: extraction, deduplication and storing, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contactloom.operators import extract, resolve
from contactloom.schemas import DATA_COLUMNS
from contactloom.sources.leads import Leads

DROP_DDL = "page_id BIGINT, url STRING, html STRING, fetched_at TIMESTAMP"


def page_drops(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(DROP_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each url once within the time that late pages are waited for; what is kept of the past is bounded by it."""
    return pages.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["url"])


def pages_per_window(pages: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pages by window of their time and by site."""
    site = F.regexp_extract("url", "://([^/?#]*)", 1).alias("site")
    return pages.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", width), site).agg(F.count("*").alias("n"))


def store(pages: DataFrame, leads: Leads, checkpoint: str, profile: str = extract.STRICT) -> StreamingQuery:
    """Records of arriving pages, upserted into the table batch by batch.

    A batch that is run again after a failure finds its own rows by website and
    name, so it updates them and inserts nothing twice.
    """

    def batch(rows: DataFrame, _: int) -> None:
        records = extract.worth_keeping(extract.extract(rows, profile)).withColumn("seq", F.col("page_id"))
        known = [c for c in DATA_COLUMNS if c in records.columns]
        whole = records.select("seq", *known, *[F.lit(None).cast("array<string>" if c == "industry_tags" else "string").alias(c) for c in DATA_COLUMNS if c not in known])
        unique = resolve.dedupe_by_hash(resolve.identified(whole))
        if not unique.isEmpty():
            leads.replace(resolve.upsert(leads.read(), unique))

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
