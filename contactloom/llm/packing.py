"""Best-fit packing of documents into bins of a fixed number of tokens, under conflicts.

A bin carries a bitmap of the duplicate clusters it has a member of, and bit
planes of its sources: plane j says of which sources it has more than j pieces.
A piece may not join a bin that has its cluster, or the most pieces allowed of
its source. Bins are ordered by residual capacity, and the successor search
goes from the piece's own size upwards until the tightest compatible bin is
found; if none is, a bin is opened. Pieces are taken by falling size.

Bins alike in residual, planes and clusters are interchangeable and are tested
as one, so a hot source or a large group of copies costs one test a residual,
not one a bin. Pieces are dealt to shards by a hash of document, piece and row,
about ``shard_pieces`` each whatever the table's size, so neither one long text
nor many rows of one id fill a shard; conflicts only concern bins, so every
shard packs by itself. Only lengths and hashes are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import ascii_lower, cut, words

CAPACITY, MAX_PER_SOURCE, SHARD_PIECES = 2048, 4, 20_000


def best_fit(pieces: Iterable[tuple[int, object, object]], capacity: int, max_per_source: int) -> list[int]:
    """Bin numbers, from 0, of pieces ``(size, source, cluster)`` in the order given; None conflicts with nothing."""
    pieces = list(pieces)
    source_bit: dict = {None: 0}
    seen: dict = {}
    for _, source, cluster in pieces:
        if source not in source_bit:
            source_bit[source] = 1 << (len(source_bit) - 1)
        seen[cluster] = seen.get(cluster, 0) + 1
    # a cluster of one piece meets no other, so it needs no bit
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}
    # residual -> saturated sources -> (planes, clusters) -> bins
    levels: dict[int, dict[int, dict[tuple, list[int]]]] = {}
    filled = 0  # bit r is set if some bin has the residual r
    out, n_bins = [], 0
    for size, source, cluster in pieces:
        s, c = source_bit[source], cluster_bit.get(cluster, 0)
        found = None
        rest = filled >> size
        r = size
        while rest:
            skip = (rest & -rest).bit_length() - 1
            r, rest = r + skip, rest >> skip
            for full, kinds in levels[r].items():
                if not full & s:
                    found = next((k for k in kinds if not k[1] & c), None)
                    if found is not None:
                        bins = kinds[found]
                        number = bins.pop()
                        if not bins:
                            del kinds[found]
                            if not kinds:
                                del levels[r][full]
                                if not levels[r]:
                                    del levels[r]
                                    filled &= ~(1 << r)
                        break
            if found is not None:
                break
            r, rest = r + 1, rest >> 1
        if found is None:
            number, r, found = n_bins, capacity, ((0,) * max_per_source, 0)
            n_bins += 1
        planes = list(found[0])
        for j in range(max_per_source):
            if not planes[j] & s:
                planes[j] |= s
                break
        kind = (tuple(planes), found[1] | c)
        left = r - size
        levels.setdefault(left, {}).setdefault(planes[-1], {}).setdefault(kind, []).append(number)
        filled |= 1 << left
        out.append(number)
    return out


def cluster_key(text: Column) -> Column:
    """The default duplicate cluster: a hash of the text's words, A-Z lower-cased; null if it has none."""
    w = words(ascii_lower(text.cast("string")))
    return F.when(F.size(w) > 0, F.xxhash64(F.array_join(w, " ")))


def pack(docs: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None) -> DataFrame:
    """``(doc_id, piece, start, n_tokens, bin)``: where every stretch of every document is packed.

    A token is a word. A document longer than a bin is cut into pieces of the
    capacity and a rest; a null or empty text is one piece of no token. Pieces
    without a source or a cluster conflict with nothing by it. Rows of one id
    are packed each by itself. Rows alike in id, source, cluster and length, which
    includes those without an id, are dealt by their place in the table too.
    ``cluster`` may name any duplicate clusters, such as near-duplicate classes.
    """
    if capacity < 1 or max_per_source < 1:
        raise ValueError("capacity and max_per_source must be 1 or more")
    text = F.col(text_col).cast("string")
    slim = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), (cluster_key(text) if cluster is None else F.xxhash64(cluster)).alias("cluster"), F.size(words(text)).alias("n")))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    n_shards = max(1, -(-(slim.agg(F.sum(n_pieces.cast("long"))).first()[0] or 0) // shard_pieces))
    # rows alike are told apart by their place, which the cut table fixes; others are dealt by what they are, however they are partitioned
    alike = slim.groupBy("doc_id", "source", "cluster", "n").agg(F.count("*").alias("k")).where("k > 1").drop("k").isEmpty()
    row = F.lit(0) if alike else F.monotonically_increasing_id()
    pieces = slim.withColumn("row", row).withColumn("piece", F.explode(F.sequence(F.lit(0), n_pieces - 1)))
    pieces = pieces.select("doc_id", "source", "cluster", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("size"), F.pmod(F.xxhash64("doc_id", "cluster", "piece", "row"), F.lit(n_shards)).alias("shard"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable")
        none = lambda column: [None if x is None or x is pd.NA or x != x else x for x in column.astype(object)]
        bins = best_fit(zip(group["size"].tolist(), none(group["source"]), none(group["cluster"])), capacity, max_per_source)
        out = group[["doc_id", "piece"]].copy()
        out["start"], out["n_tokens"] = group["piece"].astype("int64") * capacity, group["size"].astype("int64")
        out["bin"] = (int(group["shard"].iloc[0]) << 32) + pd.Series(bins, index=group.index, dtype="int64")
        return out.astype({"doc_id": "Int64", "piece": "int64"})

    return pieces.groupBy("shard").applyInPandas(run, "doc_id long, piece long, start long, n_tokens long, bin long")
