"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is a fixed mask over consecutive tokens: the tokens at its ones are
hashed, those at its zeros ignored, so a substituted token spoils only the
seeds that have a one there. Seeds of all test items are joined with the seeds
at every position of every document; each hit fixes an alignment, on which the
tokens themselves are compared around the hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import ascii_lower, cut, words

#: Two masks of weight 6. An item of 14 tokens keeps a hit with any single token replaced.
MASKS = ("11011011", "110100111")
#: Score of an overlap: a match counts 1, a substitution -2; an overlap needs this much.
MATCH, MISMATCH, LEAST_SCORE = 1, -2, 8
#: Test seeds are broadcast, each with its item's tokens, up to so many bytes; more are joined by a shuffle.
BROADCAST_BYTES = 100_000_000


def tokens(c: Column) -> Column:
    """Tokens compared: words with A-Z lower-cased."""
    return words(ascii_lower(c))


def seed_rows(tokened: DataFrame, mask: str) -> DataFrame:
    """``tokened(.., w)``, a row for each position of the mask as ``at`` (from 0) and ``seed``."""
    ones = [i for i, x in enumerate(mask) if x == "1"]
    held = tokened.where(F.size("w") >= len(mask))
    placed = held.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - len(mask))))
    return placed.withColumn("seed", F.xxhash64(F.lit(mask), *[F.get("w", F.col("at") + i) for i in ones]))


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def overlap_score(a: Column, b: Column) -> Column:
    """Best score of a stretch of two equally long token lists, by position."""
    steps = F.zip_with(a, b, lambda x, y: F.when(x == y, MATCH).otherwise(MISMATCH))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        now = F.greatest(s["now"] + x, F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(steps, zero, step, lambda s: s["best"])


def overlaps(docs: DataFrame, benchmark: DataFrame, least_score: int = LEAST_SCORE, masks: tuple[str, ...] = MASKS, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, score, start)``: every document and test item that overlap, with the best score and the least token position of an overlap of that score.

    Null and empty texts overlap nothing, as do texts and items with fewer
    tokens than a mask or than the score asked for. Rows of one doc_id count as
    one document; rows without an id are looked up like others, under null.
    Items of one id count as one item.
    """
    items = benchmark.select(F.col("item_id"), tokens(F.col("text").cast("string")).alias("item")).where(F.size("item") >= least_score)
    # exploding the list of one keeps w a column: the optimizer would else split the text anew at each use
    listed = items.select("item_id", F.explode(F.array("item")).alias("w"))
    seeds = all_of([seed_rows(listed, m) for m in masks]).select("seed", "item_id", F.col("at").alias("item_at"), F.col("w").alias("item"), F.xxhash64("w").alias("item_version"))
    seeds = cut(seeds)
    held = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(tokens(F.col(text_col).cast("string")))).alias("w"))
    first = F.greatest(F.col("at") - F.col("item_at"), F.lit(0))
    skipped = first - F.col("at") + F.col("item_at")
    # a row's keys, and for each token its place and its bytes
    weight = 64 + 16 * F.size("item") + F.octet_length(F.array_join("item", ""))
    if (seeds.agg(F.sum(weight.cast("long"))).first()[0] or 0) <= broadcast_bytes:
        # each mask meets the seeds before the union: positions, seeds and probes stay in one
        # generated loop over a document, and only hits become rows, with their stretch of tokens
        hits = [seed_rows(held, m).join(F.broadcast(seeds), "seed") for m in masks]
        length = F.least(F.size("item") - skipped, F.size("w") - first)
        aligned = all_of([h.select("doc_id", "item_id", first.alias("start"), F.slice("w", first + 1, length).alias("ours"), F.slice("item", skipped + 1, length).alias("theirs")) for h in hits])
    else:
        # the seeds alone are shuffled; texts join only those that were hit, each its own: rows of one id, or of none, may have several
        held = held.withColumn("version", F.xxhash64("w"))
        rows = all_of([seed_rows(held, m).select("doc_id", "version", "at", "seed") for m in masks])
        lines = rows.join(seeds.select("seed", "item_id", "item_version", "item_at"), "seed").select("doc_id", "version", "item_id", "item_version", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
        start = F.greatest(F.col("shift"), F.lit(0))
        skip = start - F.col("shift")
        length = F.least(F.size("item") - skip, F.size("w") - start)
        aligned = lines.join(held, lines.doc_id.eqNullSafe(held.doc_id) & (lines.version == held.version)).drop(held.doc_id, held.version).join(items.withColumn("item_version", F.xxhash64("item")), ["item_id", "item_version"]).select("doc_id", "item_id", start.alias("start"), F.slice("w", start + 1, length).alias("ours"), F.slice("item", skip + 1, length).alias("theirs"))
    # one row for each alignment, however many of its seeds were hit; only then the tokens are compared,
    # so that the interpreted comparison stays out of the generated loop
    scored = aligned.distinct().select("doc_id", "item_id", "start", overlap_score(F.col("ours"), F.col("theirs")).alias("score"))
    best = F.max(F.struct("score", (-F.col("start")).alias("back")))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).where(F.col("b.score") >= least_score).select("doc_id", "item_id", F.col("b.score").cast("long").alias("score"), (-F.col("b.back")).cast("long").alias("start"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that overlap a test item, all columns as they were. Rows without an id stay."""
    gone = overlaps(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col] == gone.gone_id, "left_anti")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d),
bp AS (SELECT item_id, w, unnest(range(0, len(w))) AS i FROM b WHERE len(w) >= 8),
ds AS (
  SELECT doc_id, i, 0 AS m, [w[i+1], w[i+2], w[i+4], w[i+5], w[i+7], w[i+8]] AS s FROM dp WHERE i + 8 <= len(w) UNION ALL
  SELECT doc_id, i, 1, [w[i+1], w[i+2], w[i+4], w[i+7], w[i+8], w[i+9]] FROM dp WHERE i + 9 <= len(w)),
bs AS (
  SELECT item_id, i, 0 AS m, [w[i+1], w[i+2], w[i+4], w[i+5], w[i+7], w[i+8]] AS s FROM bp WHERE i + 8 <= len(w) UNION ALL
  SELECT item_id, i, 1, [w[i+1], w[i+2], w[i+4], w[i+7], w[i+8], w[i+9]] FROM bp WHERE i + 9 <= len(w)),
h AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS shift FROM ds JOIN bs USING (m, s)),
a AS (
  SELECT doc_id, item_id, greatest(shift, 0) AS start,
         unnest(range(greatest(shift, 0), least(len(d.w), shift + len(b.w)))) AS p, shift, d.w AS dw, b.w AS bw
  FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
c AS (
  SELECT doc_id, item_id, shift, start, p,
         sum(CASE WHEN dw[p+1] = bw[p-shift+1] THEN 1 ELSE -2 END) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS total FROM a),
g AS (
  SELECT doc_id, item_id, shift, start,
         total - least(0, coalesce(min(total) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gain FROM c),
s AS (SELECT doc_id, item_id, shift, start, max(gain) AS score FROM g GROUP BY ALL HAVING max(gain) >= 8)
SELECT doc_id, item_id, max(score)::BIGINT AS score, max_by(start, score * 1000000 - start)::BIGINT AS start FROM s GROUP BY doc_id, item_id
"""
