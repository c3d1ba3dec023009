import random

import pytest
from pyspark.sql import functions as F

from contactloom.llm import packing
from tests.llm import plain


def replay(pieces, bins, capacity, per_source):
    """The residual of the bin that each piece went to, with all conflicts checked."""
    left, sources, clusters, out = {}, {}, {}, []
    for (size, source, cluster), b in zip(pieces, bins):
        out.append(left.setdefault(b, capacity))
        left[b] -= size
        assert left[b] >= 0
        sources.setdefault(b, []).append(source)
        assert source is None or sources[b].count(source) <= per_source
        assert cluster is None or cluster not in clusters.setdefault(b, set())
        clusters.setdefault(b, set()).add(cluster)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_tightest_compatible_bin(seed):
    rng = random.Random(seed)
    hot = seed % 2
    pieces = sorted(((rng.choice([0, 1, 5, 10, rng.randint(1, 40)]), rng.choice([None, "hot"] + ["hot"] * 5 * hot + list("abcdef")), rng.choice([None, None, *range(4 + 30 * (1 - hot))])) for _ in range(250)), key=lambda p: -p[0])
    bins = packing.best_fit(pieces, 40, 2)
    assert replay(pieces, bins, 40, 2) == packing_residuals(pieces, 40, 2)


def packing_residuals(pieces, capacity, per_source):
    """Best fit with bins alike but for the order they were opened in: the lists of residuals are the same while ties go to bins of one kind."""
    bins, out = [], []
    mine = packing.best_fit(pieces, capacity, per_source)
    for (size, source, cluster), choice in zip(pieces, mine):
        fit = [b for b in bins if b["left"] >= size and (source is None or b["sources"].count(source) < per_source) and (cluster is None or cluster not in b["clusters"])]
        out.append(min((b["left"] for b in fit), default=capacity))
        # ties are broken as the operator did, so that both go on from the same bins
        b = next((b for b in bins if b["no"] == choice), None)
        if b is None:
            assert not fit
            bins.append(b := {"no": choice, "left": capacity, "sources": [], "clusters": set()})
        b["left"] -= size
        b["sources"].append(source)
        b["clusters"].add(cluster)
    return out


def test_without_conflicts_it_is_plain_best_fit():
    rng = random.Random(1)
    pieces = sorted(((rng.randint(1, 50), None, None) for _ in range(400)), reverse=True, key=lambda p: p[0])
    assert replay(pieces, packing.best_fit(pieces, 50, 4), 50, 4) == plain.best_fit(pieces, 50, 4)


def test_many_copies_are_one_test_a_residual():
    pieces = [(10, "hot", 7)] * 20_000
    assert len(set(packing.best_fit(pieces, 100, 4))) == 20_000
    pieces = [(10, "hot", None)] * 20_000
    assert len(set(packing.best_fit(pieces, 100, 4))) == 5_000


def test_pack(spark):
    texts = [None, "", "a b c", "A  b\nc", "x " * 25, "w " * 10_001, "y z", "y z"]
    docs = plain.documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 6").withColumn("doc_id", docs.doc_id * None)).unionByName(docs.where("doc_id = 7")).withColumn("source", F.when(F.col("doc_id") != 2, F.col("source")))
    got = packing.pack(docs, 10, 2).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
        assert r.start == 10 * r.piece and 0 <= r.n_tokens <= 10
    assert sorted(sizes[0]) == sorted(sizes[1]) == [(0, 0)] and sorted(sizes[4]) == [(0, 10), (10, 10), (20, 5)]
    assert len(sizes[5]) == 1001 and sum(n for _, n in sizes[5]) == 10_001 and len(sizes[7]) == 2 and len(sizes[None]) == 1
    held = {}
    for r in got:
        held[r.bin] = held.get(r.bin, 0) + r.n_tokens
    assert max(held.values()) <= 10
    copies = [r.bin for r in got if r.doc_id in (2, 3)] , [r.bin for r in got if r.doc_id in (6, 7, None)]
    assert all(len(set(b)) == len(b) for b in copies)
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, 0)


def test_shards_pack_alone_and_do_not_depend_on_partitions(spark):
    docs = plain.documents(spark, [f"w{i} " * (i % 17) for i in range(300)])
    one = plain.rows(packing.pack(docs.repartition(7), 20, 3, shard_pieces=50))
    assert one == plain.rows(packing.pack(docs.coalesce(1), 20, 3, shard_pieces=50)) and len({r[4] >> 32 for r in one}) > 3


@pytest.mark.skipif(not plain.have_data(), reason="the driver's tables are not here")
def test_query(spark):
    from contactloom.llm import queries

    docs = {r.doc_id: r for r in spark.read.parquet(f"{plain.SMALL}/documents.parquet").collect()}
    got = queries.op2_best_fit_packing(spark, plain.SMALL).collect()
    tokens = {i: 0 for i in docs}
    for r in got:
        tokens[r.doc_id] += r.n_tokens
    assert tokens == {i: len(plain.WORD.findall(r.text or "")) for i, r in docs.items()}
    key = lambda r: (-r.n_tokens, r.doc_id, r.piece)
    ordered = sorted(got, key=key)
    pieces = [(r.n_tokens, docs[r.doc_id].source, " ".join(plain.WORD.findall(plain.lower(docs[r.doc_id].text or ""))) or None) for r in ordered]
    assert [r.bin for r in ordered] == packing.best_fit(pieces, packing.CAPACITY, packing.MAX_PER_SOURCE)
    replay(pieces, [r.bin for r in ordered], packing.CAPACITY, packing.MAX_PER_SOURCE)
