"""Document quality: base rules and a CRF over the lines of a text.

Viterbi decoding of a linear-chain conditional random field marks every line
as content or boilerplate; the share of a text's words that stand in content
lines decides whether it is kept. The field is trained from labelled lines:
a table of our own below, and, where the corpus has labels, the lines of a
bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import by_bytes, texts_of
from contactloom.llm.crf import Chain, train

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
LEAST_WORDS, LEAST_SHARE = 50, 0.5
#: At most so many labelled documents, and so many lines of each, train the field.
SAMPLE_DOCS, SAMPLE_LINES = 600, 60
CONTENT, BOILERPLATE = 0, 1
NOTICE = re.compile(r"(?i)licen[sc]ed? under|all rights reserved|copyright|©|cookie|subscribe|sign in|log ?in|click here|privacy policy|terms of (?:use|service)|read more|share (?:this|on)")
#: bins of each feature, upper ends; a value beyond all is in the last bin
BINS = {
    "words": (0, 2, 5, 15, 60), "symbols": (0, 0.1, 0.4), "bars": (0, 0.2, 0.6), "bangs": (0, 0.2, 0.6),
    "upper": (0.3, 0.6), "digits": (0.05, 0.3), "distinct": (0.15, 0.4, 0.7), "ends": (0,), "seen": (0,), "notice": (0,), "length": (2, 12),
}
OFFSETS = dict(zip(BINS, np.cumsum([0, *(len(b) + 1 for b in BINS.values())])))
N_FEATURES = sum(len(b) + 1 for b in BINS.values())
EDGES = {k: np.array(b, float) for k, b in BINS.items()}
_UPPER, _LETTERS, _DIGITS = (bytes(x, "ascii") for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789"))
_HARD = b"#*$%&<>"

#: Labelled lines: documents of (label, line), c for content and b for boilerplate.
LABELLED = (
    ("c The council met on Tuesday to discuss the new bridge, which is to open next spring.", "c Two members spoke against the plan; the rest were in favour of it.", "c It passed."),
    ("b Home | About | Products | Contact | Help", "c The first snow of the year fell over the northern valleys during the night.", "c Roads stayed open, although drivers were asked to take care on the hills.", "b All rights reserved."),
    ("b ### $$$ %%% *** &&& ###", "b Win*** big$$$ now%%% here### and&&& there***", "b Best### price$$$ today%%% only*** call&&& us###"),
    ("b BUY!! NOW!! BEST!! OFFER!! EVER!! TODAY!!", "b CLICK!! HERE!! FOR!! FREE!! STUFF!! NOW!!"),
    ("b spam spam spam spam spam spam spam spam spam spam spam spam spam spam",),
    ("b News | Sport | Weather | Travel", "b Login | Register", "b Shop | Cart | Checkout | Orders | Returns | Wishlist"),
    ("c Er ging langsam durch die alte Stadt, und niemand sprach ein Wort.", "c Am Abend kam der Regen.", "c Die Kinder liefen nach Hause."),
    ("c La casa estaba vacía cuando llegaron los primeros invitados, poco antes de la cena.", "c Nadie los esperaba."),
    ("c Le train partit à l'heure, malgré la neige qui tombait depuis le matin.", "c Il faisait froid.", "b Subscribe to our newsletter | Privacy policy | Terms of use"),
    ("c In total 14 samples were taken on 3 May, of which 11 were clean.", "c The others held traces of iron (see table 2).", "c We repeated the test a week later, with the same result."),
    ("b a | b | c | d", "b e | f | g | h | i", "b one | two | three | four | five | six | seven | eight"),
    ("c She paused.", "c Then, without another word, she opened the letter and read it to the end.", "b Read more"),
)


def line_values(lines: list[str]) -> dict[str, list]:
    """The features' values of the lines of one text."""
    out: dict[str, list] = {k: [] for k in BINS}
    seen: set[str] = set()
    for line in lines:
        b = line.encode()
        words = b.split()
        n = len(words)
        per = n or 1
        letters = len(b) - len(b.translate(None, _LETTERS))
        out["words"].append(n)
        out["symbols"].append((len(b) - len(b.translate(None, _HARD))) / per)
        out["bars"].append(b.count(b"|") / per)
        out["bangs"].append(b.count(b"!!") / per)
        out["upper"].append((len(b) - len(b.translate(None, _UPPER))) / letters if letters > 3 else 0)
        out["digits"].append((len(b) - len(b.translate(None, _DIGITS))) / (len(b) or 1))
        out["distinct"].append(len(set(words)) / n if n > 5 else 1)
        out["ends"].append(bool(n) and words[-1][-1:] in b".!?:;\"')")
        out["seen"].append(n > 0 and line in seen)
        out["notice"].append(bool(NOTICE.search(line)) if n else False)
        out["length"].append(sum(map(len, words)) / per)
        seen.add(line)
    return out


def features(values: dict[str, list]) -> np.ndarray:
    """Numbers of the active features of every line."""
    return np.stack([OFFSETS[k] + np.searchsorted(EDGES[k], np.asarray(values[k], float)) for k in BINS], axis=1)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    full = [x for x in text.split("\n") if x.strip(SPACES)]
    return n, chars, symbols, len(full) - len(set(full)), repeat_words(words)


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words that stand in a window of three words found twice or more."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    m = len(ids)
    if m < 2_000_000:
        key = (w[:-2] * m + w[1:-1]) * m + w[2:]
    else:
        pairs = np.unique(w[:-1] * m + w[1:], return_inverse=True)[1]
        key = pairs[:-1] * m + w[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= twice
    return int(covered.sum())


def own_examples() -> list[tuple[np.ndarray, np.ndarray]]:
    found = []
    for doc in LABELLED:
        labels = np.array([BOILERPLATE if x[0] == "b" else CONTENT for x in doc])
        found += [(features(line_values([x[2:] for x in doc])), labels)] * 5
    return found


def sampled_examples(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lines of labelled documents, a bounded sample, the same for the same rows.

    The lines of a document of quality 1 count as content, those of one of
    quality 0 as boilerplate; what the whole says of a line is noise that the
    field averages out.
    """
    rated = labels.where("quality in (0, 1)").select("doc_id", "quality").distinct()
    order = F.xxhash64("doc_id")
    half = sample_docs // 2
    picked = [rated.where(F.col("quality") == q).orderBy(order, "doc_id").limit(half) for q in (0, 1)]
    lines = F.slice(F.split(F.col("text").cast("string"), "\n", -1), 1, sample_lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # lines of any length stay here; what goes to the driver is a few numbers for each
        for batch in batches:
            found = [features(line_values(x)).reshape(-1).tolist() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "quality", "found"])

    held = docs.select("doc_id", lines.alias("lines")).where("lines is not null").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "lines")
    rows = held.mapInArrow(run, "doc_id long, quality long, found array<long>").orderBy(order, "doc_id", "found").limit(2 * sample_docs).collect()
    return [(np.array(r.found, np.int64).reshape(-1, len(BINS)), np.full(len(r.found) // len(BINS), CONTENT if r.quality else BOILERPLATE)) for r in rows]


def fit(docs: DataFrame | None = None, labels: DataFrame | None = None, **options) -> Chain:
    examples = own_examples()
    if docs is not None and labels is not None:
        examples += sampled_examples(docs, labels, **options)
    return train(examples, N_FEATURES, 2, rounds=120)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean, line_labels string"


def judged(texts: list[str], chain: Chain) -> list[tuple]:
    """Values of SCHEMA for every text."""
    sizes, all_features, word_counts = [], [], []
    for t in texts:
        values = line_values(t.split("\n"))
        sizes.append(len(values["words"]))
        all_features.append(features(values))
        word_counts.append(np.array(values["words"]))
    decoded = chain.decode(chain.emissions(np.concatenate(all_features)), np.array(sizes)) if texts else []
    out, at = [], 0
    for t, n, words in zip(texts, sizes, word_counts):
        mine = decoded[at : at + n]
        at += n
        counts = base_counts(t)
        failed = counts[0] < LEAST_WORDS or 100 * counts[4] > 50 * counts[0]
        share = float(words[mine == CONTENT].sum() / counts[0]) if counts[0] else 0.0
        out.append((*counts, failed, round(share, 6), not failed and share >= LEAST_SHARE, "".join("cb"[x] for x in mine)))
    return out


def judge(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as doc_id, the base counts, base_failed, content_share, kept and the labels of its lines.

    Null texts count as empty: no words, so they fail. Every row is judged by
    itself, so repeated rows and rows without an id are no special case; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            for part in by_bytes([], [len(t) for t in texts]):
                found = list(zip(*judged(texts[part], chain)))
                yield pa.RecordBatch.from_arrays([ids[part.start : part.stop], *(pa.array(c, k) for c, k in zip(found, kinds))], ["doc_id", *names])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def keep(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected rows, all columns as they were; nothing is shuffled."""

    def verdicts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            found = [x or "" for x in s]
            out: list[bool] = []
            for part in by_bytes([], [len(t) for t in found]):
                out += [x[7] for x in judged(found[part], chain)]
            yield pd.Series(out, dtype=bool)

    return docs.where(F.pandas_udf(verdicts, "boolean")(F.col(text_col).cast("string")))
