import random

import pytest
from pyspark.sql import functions as F

from contactloom.llm import line_dedup, queries
from tests.llm import plain

ARGS = (line_dedup.EVERY, line_dedup.LEAST)


def run(docs):
    found = line_dedup.dedup(docs)
    return found, sorted(((r.doc_id, r.text, r.n_chunks, r.n_removed, r.n_removed_lines) for r in found.collect()), key=repr)


def corpus():
    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    passages = [[line(rng.randint(3, 20)) for _ in range(rng.randint(2, 12))] for _ in range(5)] + [[line(70)]]
    texts = [None, "", "\n", "a\nb\n\na\nb"]
    for _ in range(40):
        own = [[line(rng.randint(1, 30))] for _ in range(rng.randint(1, 8))] + rng.sample(passages, 2)
        rng.shuffle(own)
        texts.append("\n".join(x for p in own for x in p))
    return texts + texts[6:9] + ["x" * 300_000 + "\n" + "long " * 60_000]


def test_against_plain(spark):
    texts = corpus()
    docs = plain.documents(spark, texts)
    extra = docs.where("doc_id = 5").unionByName(docs.where("doc_id in (10, 11)").withColumn("doc_id", docs.doc_id * None)).unionByName(docs.where("doc_id = 12").withColumn("doc_id", F.lit(13).cast("long")))
    docs = docs.unionByName(extra)
    data = [*enumerate(texts), (5, texts[5]), (None, texts[10]), (None, texts[11]), (13, texts[12])]
    found, got = run(docs)
    assert got == sorted(plain.line_dedup(data, *ARGS), key=repr)
    assert found.columns[: len(docs.columns)] == docs.columns and sum(r[3] for r in got) > 40
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_no_table_is_left_behind(spark):
    """Tables between the steps go once they were read, and the result is read without them."""
    docs = plain.documents(spark, corpus())
    before = plain.tables_left(spark)
    found, got = run(docs)
    assert plain.tables_left(spark) == before
    assert got == sorted(plain.line_dedup(list(enumerate(corpus())), *ARGS), key=repr)


def passages_left(spark, passage, n=40):
    """Of the documents that repeat a passage: the share that has none of its lines left, some, and the mean share of lines gone."""
    rng = random.Random(9)
    line = lambda w, n: " ".join(f"{w}{rng.randrange(10**5)}" for _ in range(n)) + "."
    own = [[line("o", rng.randint(3, 12)) for _ in range(4)] for _ in range(n)]
    first = "\n".join(x for k in range(n) for x in passage(k, line)) + "\n"
    texts = [first, *("\n".join(a[:2] + passage(k, line) + a[2:]) for k, a in enumerate(own))]
    _, got = run(plain.documents(spark, texts))
    gone = []
    for i, text, *_ in got:
        if i:
            assert all(x in text for x in own[i - 1]), "a document's own lines stay"
            said = [x for y in passage(i - 1, line) for x in y.split(". ")]
            gone.append(sum(x not in text for x in said) / len(said))
    return sum(g > 0 for g in gone) / n, sum(gone) / n


@pytest.mark.parametrize("n_lines, n_words, sentences, touched, share", [(5, 12, 1, 0.7, 0.3), (6, 10, 1, 0.8, 0.4), (8, 8, 1, 0.9, 0.55), (1, 10, 6, 0.8, 0.4), (3, 8, 4, 0.95, 0.6), (24, 8, 1, 1.0, 0.8)])
def test_passages_go_wherever_they_stand(spark, n_lines, n_words, sentences, touched, share):
    """Passages of over 50 words: few are left whole, and of the others only ends stay."""
    known: dict = {}

    def passage(k, line):
        if k not in known:
            known[k] = [" ".join(line("p", n_words) for _ in range(sentences)) for _ in range(n_lines)]
        return known[k]

    found = passages_left(spark, passage)
    assert found[0] >= touched and found[1] >= share, found


def test_hashes_that_meet_are_told_apart_by_bytes(spark, monkeypatch):
    docs = plain.documents(spark, corpus())
    want = run(docs)[1]
    monkeypatch.setattr(line_dedup, "chunk_hash", lambda c: F.pmod(F.xxhash64(c), F.lit(5)))
    assert run(docs)[1] == want


def test_clashing_names(spark):
    """Columns called as the operator's own are kept, but for those it sets."""
    docs = plain.documents(spark, corpus()).withColumns({c: F.lit(c) for c in ("gone", "cleaned_", "gone_id", "id", "row", "version", "found", "done", "own_id", "n_chunks", "h", "a")})
    got = line_dedup.dedup(docs)
    assert set(got.columns) == {*docs.columns, "n_removed", "n_removed_lines"}
    assert plain.rows(got.select("gone", "cleaned_", "gone_id", "id", "row", "version", "found", "done", "own_id", "h", "a").distinct()) == [("gone", "cleaned_", "gone_id", "id", "row", "version", "found", "done", "own_id", "h", "a")]
    assert plain.rows(got, "doc_id", "text", "n_removed") == plain.rows(line_dedup.dedup(plain.documents(spark, corpus())), "doc_id", "text", "n_removed")


def test_long_texts(spark):
    """A text of many chunks that are all removed, and one of a single line of ten million characters."""
    rng = random.Random(10)
    many = "\n".join(f"w{rng.randrange(10**6)} " * 6 for _ in range(60_000))
    _, got = run(plain.documents(spark, [many, "own words stand here\n" + many, "x" * 10_000_000]))
    assert got[0][3] == 0 and got[1][3] > 40_000 and got[1][1].startswith("own words") and len(got[1][1]) < 1000 and got[2][2:] == (1, 0, 0)


@pytest.mark.skipif(not plain.have_data(), reason="the driver's tables are not here")
def test_query_against_sql(spark):
    got, want = plain.against_sql(spark, queries.op8_line_chunk_dedup, line_dedup.SQL)
    assert got == want
