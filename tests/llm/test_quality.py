import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contactloom.llm import quality, queries
from tests.llm import plain

PROSE = "The council met on Tuesday to speak about the new bridge number {}, which is to open next spring.\nTwo members of the {} group spoke against the plan; the rest were in favour of it, after a long debate.\nNobody from district {} came, although all had been asked to do so by letter and by telephone in good time.\nIt passed with {} votes."
BARS = "\n".join(f"Home{i} | About{i} | Products{i} | Contact{i} | Help{i} | Login{i} | Register{i} | Cart{i}" for i in range(12))


@pytest.fixture(scope="module")
def chain():
    return quality.fit()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#|é ", max_size=80))
def test_counts(text):
    assert quality.base_counts(text) == plain.quality_counts(text)[:5]


def test_repeats_first_included():
    assert quality.base_counts("a b c x a b c y")[4] == 6
    assert quality.base_counts("a a a a")[4] == 4
    assert quality.base_counts("a b c")[4] == 0


def test_lines_are_labelled(chain):
    good, bad = PROSE.format(*"1234"), BARS
    got = {x[8]: x[7] for x in quality.judged([good, bad, good + "\n" + "Home | About | Login"], chain)}
    assert got["cccc"] is True and got["b" * 12] is False and got["ccccb"] is True


def test_kept_goes_by_the_share_of_content(chain):
    rows = quality.judged([PROSE.format(*"1234"), BARS, PROSE.format(*"1234") + "\n" + BARS + "\n" + BARS.replace("Home", "Start")], chain)
    assert [r[6] for r in rows][:2] == [1.0, 0.0] and rows[2][6] < 0.5 and not rows[2][7]
    assert all(r[7] == (not r[5] and r[6] >= quality.LEAST_SHARE) for r in rows)


def test_held_out_accuracy():
    """Trained on all but one labelled document, the field is right on most lines of that one."""
    right = total = 0
    for k, doc in enumerate(quality.LABELLED):
        rest = [(quality.features(quality.line_values([x[2:] for x in d])), np.array([x[0] == "b" for x in d]).astype(int)) for i, d in enumerate(quality.LABELLED) if i != k]
        chain = quality.train(rest, quality.N_FEATURES, 2, rounds=120)
        got = chain.decode(chain.emissions(quality.features(quality.line_values([x[2:] for x in doc]))), np.array([len(doc)]))
        right += int((got == np.array([x[0] == "b" for x in doc])).sum())
        total += len(doc)
    assert right >= 0.8 * total


def test_edges(spark, chain):
    texts = [None, "", PROSE.format(*"1234"), PROSE.format(*"1234"), "word " * 60, " ".join(f"w{i}" for i in range(300_000)) + "."]
    docs = plain.documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 2")).unionByName(docs.where("doc_id = 3").withColumn("doc_id", docs.doc_id * None))
    got = quality.judge(docs, chain).collect()
    assert len(got) == 8 and all(r[1:7] == plain.quality_counts(dict(enumerate(texts)).get(r.doc_id, texts[3])) for r in got)
    assert {r.doc_id: r.kept for r in got} == {0: False, 1: False, 2: True, 3: True, 4: False, 5: True, None: True}
    kept = quality.keep(docs, chain)
    assert kept.columns == docs.columns and plain.rows(kept) == plain.rows(docs.where("doc_id in (2, 3, 5) or doc_id is null"))
    assert quality.judge(docs.limit(0), chain).count() == quality.keep(docs.limit(0), chain).count() == 0


def test_fit_from_labels(spark):
    docs = plain.documents(spark, [PROSE.format(*"1234"), BARS, None])
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, 0, 0), (2, 0, 0), (9, 1, 0), (None, 1, 0), (1, None, 1)], "doc_id long, quality int, toxic int")
    assert len(quality.sampled_examples(docs, labels)) == 2
    chain = quality.fit(docs, labels)
    assert [x[7] for x in quality.judged([PROSE.format(*"5678"), BARS], chain)] == [True, False]
    assert quality.sampled_examples(docs.limit(0), labels) == [] == quality.sampled_examples(docs, labels.limit(0))


@pytest.mark.skipif(not plain.have_data(), reason="the driver's tables are not here")
def test_query_against_counts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{plain.SMALL}/documents.parquet").collect()}
    got = queries.op3_quality_line_crf(spark, plain.SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain.quality_counts(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
