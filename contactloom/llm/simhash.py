"""SimHash near-duplicates by anchor-point covering.

Fingerprints are compared only where they meet at an anchor. The anchors are
the words of a covering code of length 64: the product of four perfect codes,
two Golay codes (23 bits, covering radius 3), a Hamming code (15 bits, radius
1) and a repetition code (3 bits, radius 1), 2^36 anchors in all, so every
fingerprint lies within the covering radius of exactly one anchor, block by
block.

Two fingerprints within ``threshold`` t bits have a midpoint within ceil(t/2)
bits of both. The midpoint's anchor lies within the covering radius of it, so
within covering radius plus ceil(t/2) of both. Replicating every fingerprint
to all anchors at most ceil(t/2) beyond the covering radius therefore brings
every linked pair together; the threshold is shared between the two ends
instead of being spent on one, which takes 17 copies of a fingerprint in place
of 165 and loses nothing (tests hold it against all pairs).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import by_bytes, cut, texts_of
from contactloom.llm.components import components

#: length, generator polynomial, covering radius of each block, low bits first.
BLOCKS = ((23, 0xC75, 3), (23, 0xC75, 3), (15, 0b10011, 1), (3, 0b111, 1))
SPREAD = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, width: int, seed: int = 42) -> list[int]:
    """XXH64 of every shingle of ``width`` words; a shorter text is one shingle."""
    words = text.encode().lower().split()
    return hashes_of(words, b" ".join(words), width, seed)


def hashes_of(words: list[bytes], flat: bytes, width: int, seed: int = 42) -> list[int]:
    """The same of a text given as words and as words joined by a space."""
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(flat, seed)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [h(flat[a:b], seed) for a, b in zip(starts, ends[width - 1 :])]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes: a bit is 1 if set in over half of a group."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    begins = np.concatenate(([0], np.cumsum(n)[:-1]))
    # runs of up to 255 hashes, so that eight counters fit in a word
    runs = (n + 254) // 255
    of_run = np.repeat(np.arange(len(n)), runs)
    first = np.concatenate(([0], np.cumsum(runs)[:-1]))
    at = begins[of_run] + 255 * (np.arange(len(of_run)) - first[of_run])
    for j in range(8):
        part = np.add.reduceat((hashes >> np.uint64(j)) & SPREAD, at)
        counts = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = counts * 2 > n[:, None]
        for k in range(8):
            out[full] |= bits[:, k].astype(np.uint64) << np.uint64(8 * k + j)
    return out


def fingerprints_of(texts: list[str], width: int) -> np.ndarray:
    hashes = [np.array(shingle_hashes(t, width), np.uint64) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    return majority(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), sizes)


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: one row per document, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            for part in by_bytes([], [len(t) for t in texts]):
                fp = fingerprints_of(texts[part], width).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids[part.start : part.stop].cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


class Code:
    """A perfect cyclic code: nearest words and those one step beyond the radius."""

    def __init__(self, n: int, g: int, radius: int):
        self.n, self.radius = n, radius
        self.check = g.bit_length() - 1
        step = [0] * n
        for i in range(n):
            v = 1 << i
            while v.bit_length() > self.check:
                v ^= g << (v.bit_length() - g.bit_length())
            step[i] = v
        self.tables = []
        for low in range(0, n, 8):
            table = np.zeros(256, np.int64)
            for b in range(256):
                for i in range(min(8, n - low)):
                    if b >> i & 1:
                        table[b] ^= step[low + i]
            self.tables.append(table)
        by_weight = [{0: [0]}]
        patterns = [(0, -1, 0)]
        for _ in range(radius + 1):
            patterns = [(p | 1 << i, i, s ^ step[i]) for p, last, s in patterns for i in range(last + 1, n)]
            level: dict[int, list[int]] = {}
            for p, _, s in patterns:
                level.setdefault(s, []).append(p)
            by_weight.append(level)
        size = 1 << self.check
        self.near = np.full(size, -1, np.int64)
        for level in by_weight[: radius + 1]:
            for s, ps in level.items():
                assert self.near[s] < 0 and len(ps) == 1, "the code is not perfect"
                self.near[s] = ps[0]
        assert (self.near >= 0).all(), "the code does not cover"
        beyond = [by_weight[radius + 1].get(s, []) for s in range(size)]
        self.n_far = np.array([len(b) for b in beyond], np.int64)
        self.far_at = np.concatenate(([0], np.cumsum(self.n_far)))
        self.far = np.array([p for b in beyond for p in b], np.int64)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for k, table in enumerate(self.tables):
            out ^= table[(x >> (8 * k)) & 255]
        return out


@cache
def codes() -> tuple[Code, ...]:
    return tuple(Code(*b) for b in BLOCKS)


def near_anchors(fp: np.ndarray, blocks: tuple[Code, ...]) -> tuple[np.ndarray, np.ndarray]:
    """``(index, anchor)``: the anchors of every fingerprint that lie at most one step beyond the covering radius.

    The anchors are the products of the words of ``blocks``, low bits first.
    """
    bits = fp.view(np.uint64)
    low, parts = 0, []
    home = np.zeros(len(fp), np.uint64)
    for code in blocks:
        x = ((bits >> np.uint64(low)) & np.uint64((1 << code.n) - 1)).astype(np.int64)
        s = code.syndrome(x)
        own = (x ^ code.near[s]).astype(np.uint64) << np.uint64(low)
        parts.append((code, x, low, s, own))
        home |= own
        low += code.n
    index, found = [np.arange(len(fp))], [home]
    for code, x, low, s, own in parts:
        n = code.n_far[s]
        i = np.repeat(np.arange(len(fp)), n)
        k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + code.far_at[s[i]]
        other = (x[i] ^ code.far[k]).astype(np.uint64) << np.uint64(low)
        index.append(i)
        found.append((home[i] ^ own[i]) | other)
    return np.concatenate(index), np.concatenate(found)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``near_anchors`` for the code of this module."""
    return near_anchors(fp, codes())


def replicas(groups: DataFrame) -> DataFrame:
    """``(anchor, fp, rep)`` for every anchor of every row of ``groups(fp, rep)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = batch.column(0).to_numpy(), batch.column(1)
            for at in range(0, len(fp), 20_000):
                i, found = anchors(fp[at : at + 20_000])
                i += at
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(fp[i]), rep.take(pa.array(i))], ["anchor", "fp", "rep"])

    return groups.select("fp", "rep").mapInArrow(run, "anchor long, fp long, rep long")


def links(groups: DataFrame, threshold: int = 2) -> DataFrame:
    """``(a, b)``: representatives of every two fingerprints that differ in at most ``threshold`` bits (2 at most)."""
    if not 0 <= threshold <= 2:
        raise ValueError("this covering serves thresholds of up to 2 bits")
    dealt = replicas(groups)
    one, two = dealt.alias("x"), dealt.alias("y")
    near = (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= threshold)
    return one.join(two, near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: every document with the least doc_id that its links reach.

    Null texts count as empty; texts without a word share fingerprint zero and
    are linked like any other. Rows without a doc_id keep their fingerprint and
    get the least doc_id of its class, null if there is none. Repeated rows come
    out as often as they went in; other columns are ignored.
    """
    fps = cut(fingerprints(docs, width, id_col, text_col))
    groups = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    roots = components(links(groups.where("rep is not null"), threshold))
    # only fingerprints that are shared or linked say more than their own row does
    classes = groups.join(roots, groups.rep == roots.node, "left").where("n > 1 or root is not null").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(classes, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, the one of the least id, and all of its columns."""
    found = near_duplicates(docs, width, threshold, id_col, text_col)
    gone = found.where("doc_id > component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col] == gone.gone_id, "left_anti")
