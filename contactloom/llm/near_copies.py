"""Near copies: word-set fingerprints that meet at anchors, verified on shingles, and a prefix filter for the rest.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more. A fingerprint over all shingles moves too far for
that (up to 11 of 64 bits between such texts), one over the set of words far
less. So every text gets a few short fingerprints of its word set, each of 45
bits by a hash of its own, and texts of which one fingerprint differs by two
bits at most meet at the anchors of a covering code, the product of three
Hamming codes (2^33 anchors), as in ``simhash``. Every meeting point's least
document, its hub, is compared with the others there: one pair a row, so the
work is in proportion to the rows, however large a group is.

Fingerprints begin the classes; a prefix filter ends them. With all shingles in
one order, rare ones first, two sets of n and m shingles that share o or more
share one of the first n - o + 1 of the one and the first m - o + 1 of the
other. For a similarity of 0.8 or more, o is at least 4/9 (n + m), whatever the
edit. Every distinct text meets the others at these shingles. Where texts of
several classes meet, the one with the least share of rarer shingles is compared
with the others; then every two of different classes whose sizes, places in the
order and parities allow the similarity. Pairs within a class need no
comparison, so the classes are those of all similar pairs.

Candidates are verified on their whole shingle sets, after parities and a sketch
of the sets have ruled out most of the dissimilar (see ``promising`` for what
that may lose).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import by_bytes, cut, dropped, released, stored, texts_of
from contactloom.llm.components import components
from contactloom.llm.simhash import Code, hashes_of, majority, near_anchors, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Fingerprints of a text; bits that may differ; rounds of comparison with a meeting point's hub.
SEEDS, THRESHOLD, ROUNDS = 2, 2, 1
#: Bits of a shingle's hash that say where texts meet. Those that meet by chance are told apart when they are verified.
PLACE_BITS = 48
#: Bits of a set's parities, which rule out pairs of small sets.
PARITY = 1024
#: Bits of the sketch of a set, which rules out pairs of large ones; how many may differ; the size from which sets have one.
#: Of sets of a similarity of 0.8 a tenth differs, 25.6 +- 4.8.
SKETCH, SKETCH_SLACK, SKETCHED = 256, 46, 1500
#: Texts that say which shingles are common, about; shingles that count as such, at most. They only set the order of shingles; any order gives the same classes.
SAMPLED, COMMON = 4_000, 50_000
#: Pairs that are broadcast to the shingle sets, at most: 32 bytes each.
FEW = 100_000
#: length, generator polynomial, covering radius of each block, low bits first.
BLOCKS = ((15, 0b10011, 1),) * 3
BITS = sum(b[0] for b in BLOCKS)
MASK = np.uint64((1 << BITS) - 1)


@cache
def codes() -> tuple[Code, ...]:
    return (Code(*BLOCKS[0]),) * len(BLOCKS)


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of every hash: SplitMix64's finalizer after a step for the seed."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_prints(texts: list[list[bytes]], seeds: int = SEEDS) -> list[np.ndarray]:
    """The fingerprints of every text, given as its words: an array for each seed."""
    hashes, sizes = [], []
    h = xxhash.xxh64_intdigest
    for words in texts:
        own = set(words)
        sizes.append(len(own))
        hashes += [h(w) for w in own]
    flat, n = np.array(hashes, np.uint64), np.array(sizes, np.int64)
    return [(majority(mixed(flat, s), n) & MASK).view(np.int64) for s in range(seeds)]


def meetings(heads: DataFrame) -> DataFrame:
    """``(seed, at, fp, rep)`` for every anchor that a row of ``heads(seed, fp, rep)`` is replicated to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(1).to_numpy()
            for at in range(0, len(fp), 20_000):
                i, found = near_anchors(fp[at : at + 20_000], codes())
                rows = pa.array(i + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(found.view(np.int64)), pa.array(fp[i + at]), batch.column(2).take(rows)], ["seed", "at", "fp", "rep"])

    return heads.select("seed", "fp", "rep").mapInArrow(run, "seed int, at long, fp long, rep long")


def sketch(held: np.ndarray) -> np.ndarray:
    """One bit of the least hash in each of SKETCH bins of a set, packed into longs; zeros for a small set. Sets of similarity s differ in (1 - s) / 2 of them."""
    least = np.zeros(SKETCH, np.uint64)
    if len(held) >= SKETCHED:
        x = mixed(held, 101)
        least[:] = np.uint64(2**64 - 1)
        np.minimum.at(least, (x & np.uint64(SKETCH - 1)).astype(np.int64), x >> np.uint64(8))
    return np.packbits((least >> np.uint64(7) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def parities(held: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's elements fall on each of PARITY places, packed into longs.

    Two sets differ in no more of these than in elements, so the bound loses nothing.
    """
    places = np.bincount((held >> np.uint64(11) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY)
    return np.packbits((places & 1).astype(np.uint8)).view(np.int64)


SKETCHES, PARITIES = [f"s{k}" for k in range(SKETCH // 64)], [f"p{k}" for k in range(PARITY // 64)]
MARKS = SKETCHES + PARITIES


def prints(docs: DataFrame, width: int, similarity: float, seeds: int, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """All that is looked at of every row of ``docs(doc_id, text)``.

    ``copy`` is a digest of its words in order, ``f0, ..`` are its fingerprints,
    ``n, s0, .., p0, .., held`` the number, sketch, parities and (32-bit) hashes
    of its distinct shingles, ``firsts`` where the first of them meet others.
    """
    names = ["doc_id", "copy", *(f"f{s}" for s in range(seeds)), "n", *MARKS, "firsts", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            for part in by_bytes([], [len(t) for t in texts]):
                words = [t.encode().lower().split() for t in texts[part]]
                flat = [b" ".join(w) for w in words]
                held = [np.unique(np.array(hashes_of(w, f, width), np.uint64)) for w, f in zip(words, flat)]
                bits = np.array([np.concatenate([sketch(x), parities(x)]) for x in held], np.int64).reshape(-1, len(MARKS)).T
                firsts = [(first_shingles(x, similarity, often) >> np.uint64(64 - PLACE_BITS)).view(np.int64) for x in held]
                yield pa.RecordBatch.from_arrays([
                    ids[part.start : part.stop], pa.array([xxhash.xxh3_128_digest(f) for f in flat], pa.binary()), *map(pa.array, word_prints(words, seeds)),
                    pa.array([len(x) for x in held], pa.int64()), *map(pa.array, bits), pa.array(firsts, pa.list_(pa.int64())), pa.array([x.astype(np.uint32).view(np.int32) for x in held], pa.list_(pa.int32())),
                ], names)

    longs = ", ".join(f"{c} long" for c in (*(f"f{s}" for s in range(seeds)), "n", *MARKS))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, copy binary, {longs}, firsts array<long>, held array<int>")


def common(docs: DataFrame, width: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that most texts of a sample have, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts_of(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.array(shingle_hashes(t, width), np.uint64)).view(np.int64))], ["h"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_docs // SAMPLED))) == 0).select("text")
    found = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = np.array([r.h for r in found], np.int64).view(np.uint64), np.array([r.n for r in found], np.int64)
    return h[np.argsort(h)], n[np.argsort(h)]


def first_shingles(held: np.ndarray, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of a set of n shingles the first n - ceil(similarity n) + 1, the rare before the common."""
    if not len(held):
        return held
    n = np.zeros(len(held), np.int64)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], held), len(often[0]) - 1)
        n = np.where(often[0][at] == held, often[1][at], 0)
    most = len(held) - int(np.ceil(similarity * len(held) - 1e-9)) + 1
    return held[np.lexsort((held, n))[:most]]


def least_shared(n: Column, m: Column, similarity: float) -> Column:
    """What two sets of n and m elements share at least if they are that similar."""
    return F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9)


def in_reach(n: Column, pos: Column, m: Column, at: Column, similarity: float) -> Column:
    """Whether an element at place ``pos`` of n and ``at`` of m (from 0) may be the first that two so similar sets share."""
    o = least_shared(n, m, similarity)
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (pos <= n - o) & (at <= m - o)


def points(firsts: DataFrame, similarity: float) -> DataFrame:
    """``(at, rep, n, pos)`` of ``firsts(rep, n, firsts)`` at shingles where two texts meet or more.

    Of two texts the smaller has the shingle among its first n - 8/9 n + 1; points without such a row are no use.
    """
    each = firsts.select("rep", "n", F.posexplode("firsts").alias("pos", "at"))
    reach = F.col("pos") <= F.col("n") - least_shared(F.col("n"), F.col("n"), similarity)
    # written, so that what is exchanged to find them goes before their rows are
    shared = stored(each.groupBy("at").agg(F.count("*").alias("k"), F.max(reach).alias("reach")).where("k > 1 and reach").select("at"))
    released(firsts.sparkSession)
    met = cut(each.join(shared, "at"))
    dropped(shared)
    return met


def divided(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``met(at, rep, ..)`` at points where texts of several classes meet, with their class and the point's largest."""
    own = met.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    sizes = own.groupBy("at", "root").agg(F.count("*").alias("k"))
    several = sizes.groupBy("at").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.min("root").alias("a"), F.max("root").alias("z")).where("a < z").select("at", "main")
    return own.join(several, "at")


def near(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= threshold


def promising(similarity: float, a: str = "a_", b: str = "b_") -> Column:
    """Whether sizes, parities and sketches of two sets allow the similarity. Only sketches err, for one in 50,000 pairs just at the limit, ever fewer beyond."""
    sizes = F.least(f"{a}n", f"{b}n") >= similarity * F.greatest(f"{a}n", f"{b}n") - 1e-9
    apart, odd = (sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in names), F.lit(0)) for names in (SKETCHES, PARITIES))
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    slack = SKETCH_SLACK if similarity >= SIMILARITY else SKETCH * ((1 - similarity) / 2 + 0.08)
    return sizes & (odd <= n + m - 2 * least_shared(n, m, similarity)) & ((F.least(n, m) < SKETCHED) | (apart <= slack))


def marked(df: DataFrame, sets: DataFrame, column: str, prefix: str) -> DataFrame:
    """``df`` with size, sketch and parities of the set that ``column`` names."""
    names = ["n", *MARKS]
    return df.join(sets.select(F.col("rep").alias(column), *[F.col(c).alias(prefix + c) for c in names]), column)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingle sets are similar enough.

    Sizes and sketches come first, by which most of the dissimilar pairs go; the
    set of b moves to a's, and a document of many pairs is one row on its side.
    """
    likely = cut(marked(marked(pairs, sets, "a", "a_"), sets, "b", "b_").where(promising(similarity)).select("a", "b", "a_n", "b_n"))
    if likely.count() <= FEW:
        # few pairs go to the sets, so that only the sets of pairs are shuffled
        ha = sets.select(F.col("rep").alias("a"), F.col("held").alias("ha")).join(F.broadcast(likely), "a")
        hb = sets.select(F.col("rep").alias("b"), F.col("held").alias("hb")).join(F.broadcast(likely.select("a", "b")), "b")
        held = ha.join(hb, ["a", "b"])
    else:
        held = likely.join(sets.select(F.col("rep").alias("b"), F.col("held").alias("hb")), "b").join(sets.select(F.col("rep").alias("a"), F.col("held").alias("ha")), "a")
    both = F.size(F.array_intersect("ha", "hb"))
    return held.where(both >= similarity * (F.col("a_n") + F.col("b_n") - both)).select("a", "b")


def star_pairs(worded: DataFrame, seeds: int) -> DataFrame:
    """``(a, b)``: at every anchor and every shared fingerprint of ``worded(rep, f0, ..)``, the least document with each other one near it."""
    each = worded.select("rep", F.posexplode(F.array(*[f"f{s}" for s in range(seeds)])).alias("seed", "fp"))
    heads = cut(each.groupBy("seed", "fp").agg(F.min("rep").alias("rep"), F.count("*").alias("k")))
    alike = each.join(heads.where("k > 1").select("seed", "fp", F.col("rep").alias("a")), ["seed", "fp"]).where("rep > a").select("a", F.col("rep").alias("b"))
    # at most some 85,000 different fingerprints lie so near to one anchor, so a window serves
    here = Window.partitionBy("seed", "at")
    met = meetings(heads).withColumns({"hub": F.min("rep").over(here), "hub_fp": F.min_by("fp", "rep").over(here)})
    return met.where((F.col("rep") > F.col("hub")) & near(F.col("fp"), F.col("hub_fp"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")).unionByName(alike).distinct()


def classes(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, seeds: int = SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, class_id)`` for the rows of ``docs(doc_id, text)`` that have an id: the least doc_id that similar pairs lead to.

    Null texts count as empty. Texts without a word, and texts of the same
    words in the same order but for A-Z in lower case, are copies of one
    another; a text of fewer words than a shingle is one shingle. Rows of one
    id count as versions of one document, and come out each.
    """
    known = docs.where("doc_id is not null")
    often = common(known, width, known.count())
    # the one pass over the texts; from here on they are looked at by their hashes
    seen = stored(prints(known, width, similarity, seeds, often))
    texts = cut(seen.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k"), *[F.min(f"f{s}").alias(f"f{s}") for s in range(seeds)]))
    # texts without a word have no fingerprint to meet by
    worded = texts.where(F.col("copy") != F.lit(xxhash.xxh3_128_digest(b"")))
    near_hubs = cut(star_pairs(worded, seeds))
    released(docs.sparkSession)
    distinct = seen.select("doc_id", "copy", "n", "firsts").join(worded.select(F.col("rep").alias("doc_id"), "copy"), ["doc_id", "copy"], "left_semi")
    distinct = stored(distinct.select(F.col("doc_id").alias("rep"), "n", "firsts"))
    released(docs.sparkSession)
    met = points(distinct, similarity)
    dropped(distinct)
    released(docs.sparkSession)
    sets = seen.select(F.col("doc_id").alias("rep"), "n", *MARKS, "held")
    links = cut(verified(near_hubs, sets, similarity))
    for step in range(rounds):
        # the text with the least share of rarer shingles is nearest to what the others were made from, so most of them link to it
        rows = cut(divided(met, cut(components(links))))
        if rows.isEmpty():
            break
        met = rows.drop("root", "main")
        # the first round takes it of all, later ones of those that the largest class doesn't hold
        able = rows if not step else rows.where("root != main")
        hubs = able.groupBy("at").agg(F.min_by(F.struct("rep", "root", "n", "pos"), F.struct(F.col("pos") / F.col("n"), "rep")).alias("hub"))
        reach = in_reach(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), similarity)
        found = rows.join(hubs, "at").where((F.col("root") != F.col("hub.root")) & reach)
        links = links.unionByName(cut(verified(found.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct(), sets, similarity)))
    rows = cut(divided(met, cut(components(links))))
    released(docs.sparkSession)
    x = marked(rows.where("root != main").select("at", F.col("rep").alias("x_rep"), F.col("root").alias("x_root"), F.col("main").alias("x_main"), F.col("pos").alias("x_pos")), sets, "x_rep", "a_")
    y = marked(rows.select("at", "rep", "root", "pos"), sets, "rep", "b_")
    # places and sketches are compared in the join, so pairs that merely meet never become rows
    apart = (F.col("root") == F.col("x_main")) | (F.col("root") != F.col("x_root")) & (F.col("rep") > F.col("x_rep"))
    reach = in_reach(F.col("a_n"), F.col("x_pos"), F.col("b_n"), F.col("pos"), similarity)
    pairs = x.join(y, "at").where(apart & reach & promising(similarity)).select(F.least("rep", "x_rep").alias("a"), F.greatest("rep", "x_rep").alias("b"))
    links = links.unionByName(cut(verified(pairs.distinct(), sets, similarity)))
    roots = components(links)
    named = texts.join(roots, texts.rep == roots.node, "left").where("k > 1 or root is not null").select("copy", F.coalesce("root", "rep").alias("class_id"))
    found = cut(seen.select("doc_id", "copy").join(named, "copy", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")))
    dropped(seen)
    released(docs.sparkSession)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, that of the least id, and all of its columns; rows without an id stay."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gone = classes(slim, **options).where("doc_id > class_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col] == gone.gone_id, "left_anti")
