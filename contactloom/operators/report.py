"""Reports over leads and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.functions.text import filled, has
from contactloom.functions.urls import authority
from contactloom.schemas import EXPORT_COLUMNS
from contactloom.session import cut


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def percent(part: Column, total: Column) -> Column:
    """A share in per cent, 0 of nothing."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), total), F.lit(0.0))


PROFILE = {
    "emails": lambda: has(F.col("emails")), "phones": lambda: has(F.col("phone_numbers")), "addresses": lambda: has(F.col("addresses")),
    "social": lambda: has(F.col("social_media_links")), "industry": lambda: has(F.col("industry_tags")), "chambers": lambda: filled(F.col("chamber_name")),
}


def completeness(leads: DataFrame) -> DataFrame:
    """Total, and how many leads have each kind of value, with shares; one pass, one row."""
    counts = leads.agg(F.count("*").alias("total"), *[_n(c()).alias(f"with_{k}") for k, c in PROFILE.items()])
    return counts.select("total", *[x for k in PROFILE for x in (F.col(f"with_{k}"), percent(F.col(f"with_{k}"), F.col("total")).alias(f"{k}_pct"))])


def statistics(leads: DataFrame, processed: int = 0, seconds: float = 0.0) -> DataFrame:
    """Totals, shares, distinct sites (exact, as written) and the session's rate."""
    site = authority(F.col("website"))
    counts = leads.agg(F.count("*").alias("total_leads"), _n(has(F.col("emails"))).alias("leads_with_emails"), _n(has(F.col("phone_numbers"))).alias("leads_with_phones"), _n(filled(F.col("website"))).alias("leads_with_websites"), F.count_distinct(site).alias("unique_domains"))
    rate = processed / seconds if seconds > 0 else 0.0
    shares = [percent(F.col(f"leads_with_{k}"), F.col("total_leads")).alias(f"leads_with_{k}_pct") for k in ("emails", "phones", "websites")]
    return counts.select("*", *shares, F.lit(processed).cast("long").alias("total_processed_this_session"), F.lit(float(rate)).alias("processing_rate_per_second"), F.lit(float(seconds)).alias("elapsed_time_seconds"))


def performance(processed: int, seconds: float, identities: DataFrame) -> DataFrame:
    """A session's summary: processed, seconds, rate, distinct identities."""
    return identities.agg(F.count_distinct("hash").alias("unique_hashes_tracked")).select(F.lit(processed).cast("long").alias("total_processed"), F.lit(float(seconds)).alias("elapsed_time_seconds"), F.lit(processed / seconds if seconds > 0 else 0.0).alias("processing_rate_per_second"), "unique_hashes_tracked")


def recent(leads: DataFrame, n: int = 5) -> DataFrame:
    """The newest leads for display."""
    tags = F.concat_ws(", ", "industry_tags")
    shown = F.when(tags == "", "N/A").when(F.length(tags) > 20, F.concat(F.substring(tags, 1, 20), F.lit("..."))).otherwise(tags)
    newest = leads.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return newest.select(
        "id", F.coalesce(F.nullif("company_name", F.lit("")), F.lit("N/A")).alias("company"), F.when(filled(F.col("chamber_name")), "Chamber").otherwise("Website").alias("source"),
        shown.alias("industry"), F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("N/A")).alias("created"),
    )


def export_rows(leads: DataFrame, limit: int | None = None) -> DataFrame:
    """Leads as text, newest first: lists joined, the social map as a dictionary is written."""
    newest = leads.orderBy(F.desc("created_at"), F.desc("id"))
    newest = newest.limit(limit) if limit else newest
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    pairs = F.transform(F.map_entries("social_media_links"), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    forms = {
        "id": F.col("id").cast("string"), "phone_numbers": F.concat_ws(", ", "phone_numbers"), "emails": F.concat_ws(", ", "emails"), "industry_tags": F.concat_ws(", ", "industry_tags"),
        "addresses": F.concat_ws("; ", "addresses"), "social_media_links": F.when(has(F.col("social_media_links")), F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))).otherwise(""),
        "created_at": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"),
    }
    return newest.select(*[F.coalesce(forms.get(c, F.col(c)), F.lit("")).alias(c) for c in EXPORT_COLUMNS])


def chamber_totals(stats: DataFrame) -> DataFrame:
    """Totals over ``stats(chamber_url, inserts, updates, errors)``."""
    return stats.agg(F.count("*").alias("chambers"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("inserts", "updates", "errors")])


def action_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Inserts, updates and errors of rows with an ``action``."""
    return rows.groupBy(*by).agg(*[_n(F.col("action") == a).alias(n) for a, n in (("insert", "inserts"), ("update", "updates"), ("error", "errors"))])


def batch_summary(results: DataFrame, seconds: float = 0.0) -> DataFrame:
    """Chambers tried, successful, failed, listings found, pages estimated, chambers an hour."""
    pages = F.sum(F.when(F.col("success"), F.greatest(F.lit(1), F.floor(F.col("n_businesses") / 20))))
    totals = results.agg(F.count("*").alias("attempted"), _n(F.col("success")).alias("successful"), _n(~F.col("success")).alias("failed"), F.coalesce(F.sum(F.when(F.col("success"), F.col("n_businesses"))), F.lit(0)).cast("long").alias("businesses"), F.coalesce(pages, F.lit(0)).cast("long").alias("pages"))
    return totals.withColumn("chambers_per_hour", F.lit(0.0) if seconds <= 0 else F.col("attempted") * (3600.0 / seconds))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Pages processed, saved and failed, of ``outcomes(saved)``."""
    return outcomes.agg(F.count("*").alias("processed"), _n(F.col("saved")).alias("saved"), _n(~F.coalesce("saved", F.lit(False))).alias("failed"))


def batches(rows: DataFrame, order: str, size: int, by: str = "batch") -> DataFrame:
    """Rows with the number of their batch by a dense order column that starts at 1."""
    return rows.withColumn(by, F.floor((F.col(order) - 1) / size).cast("long"))


def dense_numbers(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``number``, 1 and up by a unique column: ranged, ranked within ranges, and moved by the ranges' sizes."""
    ranged = cut(df.repartitionByRange(column).withColumn("part_", F.spark_partition_id()))
    sizes = ranged.groupBy("part_").agg(F.count("*").alias("n_"))
    before = sizes.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    rank = F.row_number().over(Window.partitionBy("part_").orderBy(column))
    return ranged.join(F.broadcast(before), "part_").withColumn("number", (rank + F.col("before_")).cast("long")).drop("part_", "before_")
