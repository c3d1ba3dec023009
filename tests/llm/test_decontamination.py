import random

import pytest

from contactloom.llm import decontamination as dc
from contactloom.llm import queries
from tests.llm import plain


def fixture():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**5)}"
    items = {k: " ".join(word() for _ in range(rng.randint(14, 40))) for k in range(12)}
    items |= {20: None, 21: "", 22: "too short to say", 23: items[0], 24: "a a a a a a a a a a a a"}
    docs = {0: None, 1: "", 2: "\n \t", 3: "too short to say", 4: "A " * 30, 5: "clean " + " ".join(word() for _ in range(400))}
    for d in range(10, 40):
        w = items[d % 12].split()
        for _ in range(d % 4):
            w[rng.randrange(len(w))] = word()
        cut = w[rng.randint(0, 6) :] if d % 5 == 0 else w
        docs[d] = " ".join(word() for _ in range(rng.randint(0, 30))) + "\n" + "  ".join(x.upper() for x in cut) + "\t" + " ".join(word() for _ in range(rng.randint(0, 30)))
    docs[50] = " ".join(word() for _ in range(100_000)) + " " + items[1]
    docs[51] = " ".join([items[2]] * 50)
    return docs, items


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], "doc_id long, text string, item_id string, at int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items.items()], "item_id long, text string, doc_id string")
    return d, b


def test_against_plain(tables):
    docs, items = fixture()
    want = sorted(((d, k, s, a) for (d, k), (s, a) in plain.overlaps(docs, items, dc.MASKS, dc.LEAST_SCORE).items()), key=repr)
    assert plain.rows(dc.overlaps(*tables)) == want
    # too many seeds to broadcast: joined by a shuffle, with the same result
    assert plain.rows(dc.overlaps(*tables, broadcast_bytes=0)) == want


def test_rows_of_one_id_or_none(tables):
    """Several texts under one id, and under none, and items of one id: the same on either path."""
    d, b = tables
    more = d.unionByName(d.where("doc_id in (10, 11, 14)").withColumn("doc_id", d.doc_id * None)).unionByName(d.where("doc_id in (12, 13)").withColumn("doc_id", d.doc_id * 0 + 15))
    items = b.unionByName(b.where("item_id = 3").withColumn("item_id", b.item_id * 0 + 4))
    got = plain.rows(dc.overlaps(more, items))
    assert got == plain.rows(dc.overlaps(more, items, broadcast_bytes=0)) and sum(r[0] is None for r in got) >= 3 and sum(r[0] == 15 for r in got) >= 3


def test_any_substituted_token_is_tolerated(spark):
    w = [f"t{i}" for i in range(14)]
    texts = [" ".join(w[:k] + ["other"] + w[k + 1 :]) for k in range(14)]
    got = dc.overlaps(plain.documents(spark, texts), spark.createDataFrame([(1, " ".join(w))], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {k for k in range(14) if max(k, 13 - k, 11 if 0 < k < 13 else 13) >= 8}


def test_clean(spark, tables):
    d, b = tables
    more = d.unionByName(d.where("doc_id = 12")).unionByName(d.where("doc_id = 13").withColumn("doc_id", d.doc_id * None))
    kept = dc.clean(more, b)
    dirty = {r.doc_id for r in dc.overlaps(d, b).collect()}
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(fixture()[0]) - dirty | {None} and {0, 1, 2, 3, 5} <= set(fixture()[0]) - dirty
    assert dc.overlaps(d.limit(0), b).count() == dc.overlaps(d, b.limit(0)).count() == 0
    assert dc.clean(d, b.limit(0)).count() == d.count()


def test_no_python_in_the_plan(tables):
    for size in (0, 10**8):
        plan = dc.overlaps(*tables, broadcast_bytes=size)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.skipif(not plain.have_data(), reason="the driver's tables are not here")
def test_query_against_sql(spark):
    got, want = plain.against_sql(spark, queries.op10_spaced_seed_decontamination, dc.SQL)
    assert got == want
