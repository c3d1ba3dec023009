import random

import numpy as np
import pytest

from contactloom.llm import components, near_copies, queries, simhash
from tests.llm import plain


def test_codes_are_perfect():
    for code in {c.n: c for c in simhash.codes()}.values():
        assert 2 ** (code.n - code.check) * len([s for s in code.near]) == 2**code.n
        x = np.arange(1 << code.n, dtype=np.int64) if code.n < 16 else np.random.default_rng(0).integers(0, 1 << code.n, 5000)
        home = x ^ code.near[code.syndrome(x)]
        assert not code.syndrome(home).any() and all((int(a) ^ int(b)).bit_count() <= code.radius for a, b in zip(x, home))


@pytest.mark.parametrize("blocks, bits", [(simhash.codes, 64), (near_copies.codes, near_copies.BITS)])
def test_close_fingerprints_share_an_anchor(blocks, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(bits) for _ in range(3000)]
    flips = [sum(1 << b for b in rng.sample(range(bits), rng.randint(0, 2))) for _ in base]
    sets = []
    for values in (base, [a ^ f for a, f in zip(base, flips)]):
        i, found = simhash.near_anchors(np.array(values, np.uint64).view(np.int64), blocks())
        own = [set() for _ in base]
        for k, a in zip(i, found):
            own[k].add(int(a))
        sets.append(own)
    assert all(a & b for a, b in zip(*sets))


def test_majority():
    rng = np.random.default_rng(5)
    sizes = np.array([0, 1, 2, 254, 255, 256, 700, 0, 3])
    h = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64) * np.uint64(2)
    at, want = 0, []
    for n in sizes:
        own = [int(x) for x in h[at : at + n]]
        want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > n))
        at += n
    assert [int(x) for x in simhash.majority(h, sizes)] == want


def variants(rng, words, n):
    out = []
    for _ in range(n):
        w = list(words)
        for k in rng.sample(range(len(w)), rng.choice([0, 1, 2, 5, 20, 60])):
            w[k] = f"y{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed=2):
    rng = random.Random(seed)
    texts = [None, "", " \n", "One", "one", "two words", "a b c", "A b  c"]
    for _ in range(6):
        texts += variants(rng, [f"w{rng.randrange(10**6)}" for _ in range(300)], 12)
    return texts


def test_near_duplicates_against_all_pairs(spark):
    texts = corpus()
    docs = plain.documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 9").withColumn("doc_id", docs.doc_id * None))
    fp, root = plain.simhash_classes(dict(enumerate(texts)))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r.fp % 2**64 == fp[9 if r.doc_id is None else r.doc_id] and r.component_id == root[9 if r.doc_id is None else r.doc_id]
    assert root[1] == root[2] == 0 and root[4] == 3
    kept = simhash.keep_one(docs, 3)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(root.values()) | {None}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(docs, 3)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (5, 5), (None, 4), (20, 30), (30, 40), (40, 50), (50, 60), (2, 1)]
    got = dict(plain.rows(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 20, 30: 20, 40: 20, 50: 20, 60: 20}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_against_all_pairs(spark):
    texts = corpus(4)
    docs = plain.documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 9").withColumn("doc_id", docs.doc_id * None))
    ids = range(len(texts))
    pairs = {(a, b) for a in ids for b in range(a + 1, len(texts)) if plain.jaccard(texts[a], texts[b]) >= 0.8}
    true = plain.components(ids, pairs)
    got = {r.doc_id: r.class_id for r in near_copies.classes(docs).collect()}
    assert len(pairs) > 60 and got == true
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got.values()) | {None}
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_near_copies_leave_no_table_behind(spark):
    """Tables between the steps go once they were read, so they lie on no disk beside what later steps write."""
    docs = plain.documents(spark, corpus(5))
    before = plain.tables_left(spark)
    found = near_copies.classes(docs)
    assert plain.tables_left(spark) == before
    assert found.count() == docs.count()


def test_a_group_of_copies_costs_its_size(spark, monkeypatch):
    """Pairs compared in a group of near copies are a small multiple of the group, not its square."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(400):
        w = list(words)
        for k in rng.sample(range(300), 2):
            w[k] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    seen = []
    verified = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *a: (seen.append(pairs.count()), verified(pairs, *a))[1])
    got = near_copies.classes(plain.documents(spark, texts)).collect()
    assert {r.class_id for r in got} == {0} and sum(seen) < 20 * len(texts)


def test_sketches_and_parities_tell_similarity():
    """Sets of a similarity of 0.8 or more pass; of small ones parities keep most others out, of large ones sketches."""
    rng = np.random.default_rng(11)
    apart = lambda f, x, y: sum((int(a) ^ int(b)).bit_count() for a, b in zip(f(x).view(np.uint64), f(y).view(np.uint64)))
    for n, f, bound in ((60, near_copies.parities, 14), (400, near_copies.parities, 90), (3000, near_copies.sketch, near_copies.SKETCH_SLACK), (20_000, near_copies.sketch, near_copies.SKETCH_SLACK)):
        for similarity in (1.0, 0.9, 0.81, 0.5, 0.3, 0.0):
            both = round(2 * n * similarity / (1 + similarity))
            own = rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
            assert (apart(f, own[:n], np.concatenate([own[:both], own[n:]])) <= bound) == (similarity > 0.8), (n, similarity)


def test_near_copies_rounds_do_not_change_the_classes(spark):
    docs = plain.documents(spark, corpus(6))
    assert plain.rows(near_copies.classes(docs, rounds=0)) == plain.rows(near_copies.classes(docs, rounds=4))


def test_near_copies_behind_another_text_of_their_fingerprints(spark):
    """A text of the same words in another order, and a lesser id, stands for no one else's shingles."""
    rng = random.Random(12)
    texts = []
    while len(texts) < 30:
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        copy = list(base)
        for k in range(20, 26):
            copy[k] = f"y{rng.randrange(10**6)}"
        apart = [(int(a[0]) ^ int(a[1])).bit_count() for a in near_copies.word_prints([[x.encode() for x in w] for w in (base, copy)], 6)]
        if 0 not in apart and min(apart) <= near_copies.THRESHOLD:
            texts += [" ".join(rng.sample(base, 300)), " ".join(copy), " ".join(base)]
    got = {r.doc_id: r.class_id for r in near_copies.classes(plain.documents(spark, texts)).collect()}
    assert got == {k: k - (k % 3 == 2) for k in range(len(texts))}


def test_near_copies_by_kind_of_edit(spark):
    """Pairs of a similarity of 0.80 to 0.85, whatever was edited."""
    rng = random.Random(13)
    new = lambda n: [f"y{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for k in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        copy = list(base)
        if k % 3 == 0:
            copy += new(80)
        elif k % 3 == 1:
            copy[100:138] = new(38)
        else:
            for at in range(10, 400, 50):
                copy[at] = new(1)[0]
        texts += [" ".join(base), " ".join(copy)]
        assert 0.80 <= plain.jaccard(*texts[-2:]) < 0.85
    got = {r.doc_id: r.class_id for r in near_copies.classes(plain.documents(spark, texts)).collect()}
    found = [sum(got[2 * k + 1] == 2 * k for k in range(kind, 60, 3)) for kind in range(3)]
    assert min(found) >= 19, found


@pytest.mark.skipif(not plain.have_data(), reason="the driver's tables are not here")
def test_query_against_all_pairs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{plain.SMALL}/documents.parquet").collect()}
    fp, root = plain.simhash_classes(texts)
    assert plain.rows(queries.op7_simhash_anchor_dedup(spark, plain.SMALL)) == sorted(((i, f"{fp[i]:016x}", root[i]) for i in texts), key=repr)
