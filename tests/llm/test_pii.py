import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contactloom.llm import crf, pii, queries
from tests.llm import plain


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1@.-+ 90()25é\n%", max_size=60))
def test_base_patterns(text):
    assert [(a, pii.NAMES[k], b) for a, k, b in pii.base_spans(text)] == [(a, k, b) for a, _, k, b in plain.pii_spans(text)]


def test_base_examples():
    text = "a@b.co, x@y (no), 10.0.0.255 and 10.0.0.256; 4111 1111 1111 1111; 4111111111111112; +49 30 1234567; +1 22"
    assert [(pii.NAMES[k], text[a:b]) for a, k, b in pii.base_spans(text)] == [("email", "a@b.co"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+49 30 1234567")]


def test_field_adds_what_patterns_miss():
    text = "call (212) 555-0187 or pay with 4111111111111112, SSN 321-54-9876, from 1990 to 1994 in 12 rooms"
    base, spans = pii.find([text])[0]
    found = {(pii.NAMES[k], text[a:b]) for a, k, b in spans}
    assert not base
    assert {("crf_phone", "(212) 555-0187"), ("crf_card", "4111111111111112"), ("crf_id", "321-54-9876")} == found


def test_plain_text_has_no_spans():
    assert pii.find(["The room has 24 seats, and it opened on 3 May 2019.\nNobody came.", "", "word " * 1000])  == [([], [])] * 3


def test_base_stays_beside_the_field():
    text = "mail jane.roe@firm.org or (415) 555-2671 now"
    base, spans = pii.find([text])[0]
    assert set(base) <= set(spans) and len(spans) == 2


def decoded_whole(text):
    """Labels of all tokens of a text, decoded as one sequence: (token span, label)."""
    model = pii.field()
    tokens = [m.span() for m in plain.WORD.finditer(text)]
    words = [text[a:b] for a, b in tokens]
    marked = [bool(pii._MARK.search(w)) for w in words]
    scores = model.chain.emissions(model.features([model._names(words, i) for i in range(len(words))]))
    for i in range(len(words)):
        if not any(marked[max(0, i - 1) : i + 2]):
            scores[i, 0] += model.lift
    labels = model.chain.decode(scores, np.array([len(words)]))
    return {t: pii.LABELS[x] for t, x in zip(tokens, labels) if x}


def test_stretches_decode_like_whole_texts():
    rng = random.Random(1)
    pool = ["the", "Word", "UPPER", "it's", "#", "4111111111111112", "(415)", "555-2671", "078-05-1120", "1990", "a@b", "phone", "12", "über", "|"]
    for _ in range(200):
        text = " ".join(rng.choices(pool, weights=[6, 3, 1, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 1], k=rng.randint(1, 40)))
        spans = [s for s in pii.added_spans([text], [[]])[0]]
        whole = decoded_whole(text)
        begins = {pii.trim(text, *t)[0] for t, x in whole.items() if x[0] == "B" and pii.trim(text, *t)[0] < pii.trim(text, *t)[1]}
        assert {a for a, _, _ in spans} >= begins
        covered = {i for a, _, b in spans for i in range(a, b)}
        assert all(any(i in covered for i in range(*t)) or not any(text[i].isalnum() for i in range(*t)) for t in whole)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    chain = crf.Chain(np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    sizes = np.array([4, 0, 1, 6])
    scores = rng.normal(size=(sizes.sum(), 3))
    got, at = chain.decode(scores, sizes), 0
    for n in sizes:
        own = scores[at : at + n]
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T if n else np.zeros((1, 0), int)
        value = [sum(own[i, y] for i, y in enumerate(p)) + (chain.start[p[0]] if n else 0) + sum(chain.move[a, b] for a, b in zip(p, p[1:])) for p in paths]
        assert list(got[at : at + n]) == list(paths[int(np.argmax(value))])
        at += n


def test_training_learns():
    x = np.array([[0], [1], [1], [0]])
    chain = crf.train([(x, np.array([0, 1, 1, 0]))] * 3, 2, 2, rounds=80)
    assert list(chain.decode(chain.emissions(x), np.array([4]))) == [0, 1, 1, 0]
    empty = crf.train([], 2, 2)
    assert list(empty.decode(empty.emissions(x), np.array([4]))) == [0, 0, 0, 0]


def test_edges(spark):
    texts = [None, "", "a@b.co", "a@b.co", "x " * 200_000 + "me@there.org", "\n \t"]
    docs = plain.documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 2")).unionByName(docs.where("doc_id = 3").withColumn("doc_id", docs.doc_id.cast("long") * None))
    got = pii.spans_of(docs).collect()
    assert sorted(r.n_email for r in got) == [0, 0, 0, 1, 1, 1, 1, 1] and sum(r.doc_id is None for r in got) == 1
    by = {r.doc_id: r for r in got}
    assert by[4].spans == "email:400000:400012" and by[0].base_sha256 == plain.digest([]) == by[1].base_sha256
    assert pii.spans_of(docs.limit(0)).count() == 0


@pytest.mark.skipif(not plain.have_data(), reason="the driver's tables are not here")
def test_query_against_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{plain.SMALL}/documents.parquet").collect()}
    got = queries.op1_pii_crf(spark, plain.SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain.pii_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, _, k, _ in base) for kind in pii.KINDS)
        assert r.base_sha256 == plain.digest(base)
        assert {f"{k}:{a}:{b}" for a, _, k, b in base} <= set(r.spans.split(","))
