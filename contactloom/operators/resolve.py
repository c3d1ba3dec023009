"""From business listings to stored leads: normalising, deduplication, matching, upsert."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.functions.text import filled
from contactloom.operators.components import components
from contactloom.schemas import DATA_COLUMNS
from contactloom.session import cut

TEXTS = ("name", "company_name", "business_name", "website", "phone", "email", "address", "industry", "source_url", "description")


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def normalized(businesses: DataFrame, chamber_name: Column | None = None, chamber_url: Column | None = None) -> DataFrame:
    """Business listings as records; other columns (seq, chamber_seq) stay.

    Missing columns count as null. The chamber's name and url are columns of
    the listings unless given.
    """
    b = businesses
    for c in TEXTS:
        if c not in b.columns:
            b = b.withColumn(c, F.lit(None).cast("string"))
    for c, given in (("chamber_name", chamber_name), ("chamber_url", chamber_url)):
        b = b.withColumn(c, given if given is not None else F.col(c) if c in b.columns else F.lit(None).cast("string"))
    site = F.when(filled(F.col("website")) & ~F.regexp_like("website", F.lit("^https?://")), F.concat(F.lit("https://"), F.col("website"))).otherwise(F.col("website"))
    one = lambda c: F.when(filled(F.col(c)), F.array(F.col(c)))
    extra = [c for c in businesses.columns if c not in (*TEXTS, *DATA_COLUMNS)]
    social = F.col("social_media_links") if "social_media_links" in b.columns else F.lit(None).cast("map<string,string>")
    return b.select(
        *extra, first_filled(F.col("name"), F.col("company_name"), F.col("business_name")).alias("company_name"), site.alias("website"),
        first_filled(F.col("source_url"), F.col("chamber_url")).alias("scraped_from_url"), site.alias("canonical_url"), "description",
        one("phone").alias("phone_numbers"), one("email").alias("emails"), one("address").alias("addresses"), social.alias("social_media_links"), one("industry").alias("industry_tags"),
        "chamber_name", "chamber_url",
    )


def identified(records: DataFrame) -> DataFrame:
    """Records with a name or a website."""
    return records.where(filled(F.col("company_name")) | filled(F.col("website")))


def _key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))


def identity_hash(website: Column, name: Column) -> Column:
    """MD5 of the lower-case website and name."""
    return F.md5(F.concat_ws("|", _key(website), _key(name)).cast("binary"))


def first_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an order that is total.

    A keyed minimum instead of a ranking: rows of a hot key are combined in
    the map stage, and nothing is sorted.
    """
    rest = [c for c in df.columns if c not in (*key, *order)]
    least = F.min_by(F.struct(*order, *rest), F.struct(*order))
    return df.groupBy(*key).agg(least.alias("r_")).select(*[F.col(c) if c in key else F.col(f"r_.{c}") for c in df.columns])


def dedupe_by_hash(records: DataFrame, order: str = "seq", seen: DataFrame | None = None) -> DataFrame:
    """The first record of each identity; identities in ``seen(hash)`` have had theirs."""
    hashed = records.withColumn("hash", identity_hash(F.col("website"), F.col("company_name")))
    if seen is not None:
        hashed = hashed.join(seen.select("hash").distinct(), "hash", "left_anti").select(hashed.columns)
    return first_of_each(hashed, ["hash"], [order]).select(hashed.columns)


def dedupe_by_name(listings: DataFrame, order: str = "seq", within: str = "chamber_url") -> DataFrame:
    """The first listing of each name and website within a chamber; those with neither go."""
    keyed = listings.withColumns({"n_": _key(F.col("name")), "w_": _key(F.col("website"))}).where("n_ <> '' or w_ <> ''")
    ranked = keyed.withColumn("key_", F.concat_ws("|", "n_", "w_"))
    return first_of_each(ranked.drop("n_", "w_"), [within, "key_"], [order]).select(listings.columns)


def matches(incoming: DataFrame, leads: DataFrame) -> DataFrame:
    """``incoming`` with ``lead_id``: the least id of a lead with its website or its name, null if none.

    Two equi-joins in place of a join on either: each lead key is brought down
    to its least id first, so each join adds one column and no row.
    """
    by = lambda key: leads.where(f"{key} is not null").groupBy(key).agg(F.min("id").alias(f"by_{key}"))
    both = incoming.join(by("website"), "website", "left").join(by("company_name"), "company_name", "left")
    return both.select(*incoming.columns, F.least("by_website", "by_company_name").alias("lead_id"))


# --- upsert: records meet leads in order, an update changes what later ones meet


def blocks(nodes: DataFrame) -> DataFrame:
    """``(node, block)`` for ``nodes(node, website, company_name)``: rows that share a value, directly or in a chain.

    Each value ties its rows to the least of them, which is one row a value and
    no pair of rows; what hangs together is found from these ties.
    """
    tagged = F.array(F.concat(F.lit("w"), F.col("website")), F.concat(F.lit("n"), F.col("company_name")))
    keys = nodes.select("node", F.explode(tagged).alias("key")).where("key is not null")
    least = keys.groupBy("key").agg(F.min("node").alias("b"))
    ties = keys.join(least, "key").select(F.col("node").alias("a"), "b")
    found = components(ties)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("block"))


def fold(rows: list[dict], update_existing: bool) -> tuple[list[dict], int, int, int]:
    """Leads after incoming rows were taken one by one; inserts, updates and rows that matched but were not to update.

    ``rows`` are leads (with ``id``) and incoming records (without), in order. A
    record matches the lead of the least id that has its website or its name
    now; an update writes each value that is not null.
    """
    leads: list[dict] = []
    by: dict[str, dict[str, list[dict]]] = {"website": {}, "company_name": {}}
    inserts = updates = ignored = 0

    def enter(lead: dict) -> None:
        for k, index in by.items():
            if lead[k] is not None:
                index.setdefault(lead[k], []).append(lead)

    for row in rows:
        if row["id"] is not None:
            leads.append(row)
            enter(row)
            continue
        met = [x for k, index in by.items() if row[k] is not None for x in index.get(row[k], ())]
        if not met:
            new = dict(row) | {"order_": (1, row["seq"])}
            leads.append(new)
            enter(new)
            inserts += 1
        elif update_existing:
            lead = min(met, key=lambda x: x["order_"])
            for k, index in by.items():
                if lead[k] is not None and row[k] is not None and row[k] != lead[k]:
                    index[lead[k]] = [x for x in index[lead[k]] if x is not lead]
                    index.setdefault(row[k], []).append(lead)
                elif lead[k] is None and row[k] is not None:
                    index.setdefault(row[k], []).append(lead)
            lead.update({k: row[k] for k in DATA_COLUMNS if row[k] is not None}, updated_=True)
            updates += 1
        else:
            ignored += 1
    return leads, inserts, updates, ignored


def upsert(leads: DataFrame, incoming: DataFrame, update_existing: bool = True, now: Column | None = None) -> DataFrame:
    """Leads after ``incoming(seq, ...)`` came in by seq, with ``action``: insert, update or keep.

    A record meets leads that have its website or its name, so leads with no
    value of what comes in are kept as they are and take no part. Rows that
    could ever meet share a block, so each block is folded by itself (see
    ``blocks``); blocks of a single row, nearly all of them, are decided without
    it. New ids follow the largest one in the order of seq.
    """
    now = now if now is not None else F.current_timestamp()
    shares = lambda key: leads.join(incoming.where(f"{key} is not null").select(key).distinct(), key, "left_semi").select("id")
    met_ids = cut(shares("website").unionByName(shares("company_name")).distinct())
    apart = leads.join(met_ids, "id", "left_anti").select("id", *DATA_COLUMNS, "created_at", "updated_at", F.lit("keep").alias("action"))
    stored = leads.join(met_ids, "id", "left_semi").select(F.concat(F.lit("l"), F.lpad(F.col("id").cast("string"), 20, "0")).alias("node"), F.col("id"), F.lit(None).cast("long").alias("seq"), *DATA_COLUMNS, "created_at", "updated_at")
    came = incoming.select(F.concat(F.lit("r"), F.lpad(F.col("seq").cast("string"), 20, "0")).alias("node"), F.lit(None).cast("long").alias("id"), F.col("seq").cast("long"), *DATA_COLUMNS, F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    rows = cut(stored.unionByName(came))
    placed = cut(rows.join(blocks(rows.select("node", "website", "company_name")), "node"))
    sizes = placed.groupBy("block").agg(F.count("*").alias("size_"))
    placed = placed.join(sizes, "block")
    alone = placed.where("size_ = 1").withColumn("action", F.when(F.col("id").isNull(), "insert").otherwise("keep"))
    fields = [f for f in alone.schema.fields if f.name not in ("size_",)]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])

    def run(batches):
        import pyarrow as pa

        form = None

        def rows_in():
            nonlocal form
            for batch in batches:
                form = batch.schema
                yield from batch.to_pylist()

        out = []
        # blocks come one after another, each of them whole
        for _, block in groupby(rows_in(), key=lambda r: r["block"]):
            folded, *_ = fold([r | {"order_": (0, r["id"])} for r in block], update_existing)
            out += [r | {"action": "insert" if r["id"] is None else "update" if r.get("updated_") else "keep"} for r in folded]
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema=form)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=form)

    together = placed.where("size_ > 1").drop("size_").withColumn("action", F.lit(None).cast("string")).select(*[f.name for f in fields])
    met = together.repartition("block").sortWithinPartitions("block", "node").mapInArrow(run, schema)
    all_ = cut(alone.drop("size_").unionByName(met))
    return _numbered(all_, leads).select(
        "id", *DATA_COLUMNS,
        F.when(F.col("action") == "insert", now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(F.col("action") != "keep", now).otherwise(F.col("updated_at")).alias("updated_at"), "action",
    ).unionByName(apart)


def _numbered(rows: DataFrame, leads: DataFrame) -> DataFrame:
    """New rows numbered by seq after the largest id, without a window over all of them.

    Rows are ranged by seq; each range's count is summed over the ranges before
    it, and within a range the number is the rank.
    """
    new = cut(rows.where("id is null").drop("id").repartitionByRange(F.col("seq")).withColumn("part_", F.spark_partition_id()))
    counts = new.groupBy("part_").agg(F.count("*").alias("n_"))
    before = counts.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part_", "before_")
    most = leads.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    rank = F.row_number().over(Window.partitionBy("part_").orderBy("seq"))
    numbered = new.join(F.broadcast(before), "part_").withColumn("id", (rank + F.col("before_")).cast("long")).withColumn("id", F.col("id") + most.scalar()).drop("part_", "before_")
    return rows.where("id is not null").unionByName(numbered.select(rows.columns))


def counters(businesses: DataFrame, upserted: DataFrame, skipped: int, valid: int) -> dict[str, int]:
    """What an upsert did: attempted, inserts, updates, duplicates skipped, errors."""
    attempted = businesses.count()
    if not valid:
        return {"total_attempted": attempted, "successful_inserts": 0, "successful_updates": 0, "duplicates_skipped": skipped, "errors": attempted - skipped if attempted else 0}
    done = {r["action"]: r["count"] for r in upserted.groupBy("action").count().collect()}
    return {"total_attempted": attempted, "successful_inserts": done.get("insert", 0), "successful_updates": done.get("update", 0), "duplicates_skipped": skipped, "errors": 0}
