import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contactloom.llm import decontamination as dc
from contactloom.llm import line_dedup, packing, quality
from tests.llm import plain

pytestmark = pytest.mark.skipif(not plain.have_data(), reason="the driver's tables are not here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_run(spark):
    """The stages over lists; near copies by all pairs, packing judged by its own replay."""
    read = lambda t: spark.read.parquet(f"{plain.SMALL}/{t}.parquet")
    docs = [tuple(r) for r in read("documents").select(*COLUMNS).orderBy("doc_id").collect()]
    chain = quality.fit(read("documents"), read("labels"))
    verdicts = {d[0]: not plain.quality_counts(d[1])[5] and quality.judged([d[1] or ""], chain)[0][6] >= quality.LEAST_SHARE for d in docs}
    docs = [d for d in docs if verdicts[d[0]]]
    stages = [docs]
    cleaned = {i: (t, n) for i, t, _, n, _ in plain.line_dedup([d[:2] for d in docs], line_dedup.EVERY, line_dedup.LEAST)}
    docs = [(d[0], t, d[2], d[3], len(t) if n else d[4]) for d in docs for t, n in [cleaned[d[0]]] if not n or plain.WORD.search(t)]
    stages.append(docs)
    ids = [d[0] for d in docs]
    text = {d[0]: d[1] for d in docs}
    sets = {i: set(plain.shingles(t, 5)) for i, t in text.items()}
    alike = ((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    root = plain.components(ids, alike)
    docs = [d for d in docs if root[d[0]] == d[0]]
    stages.append(docs)
    dirty = {d for d, _ in plain.overlaps({d[0]: d[1] for d in docs}, {r.item_id: r.text for r in read("benchmark").collect()}, dc.MASKS, dc.LEAST_SCORE)}
    stages.append([d for d in docs if d[0] not in dirty])
    return stages


def test_run_against_plain(spark):
    docs = spark.read.parquet(f"{plain.SMALL}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], plain_run(spark)):
        docs = stage(spark, docs, plain.SMALL)
        assert docs.columns == COLUMNS, name
        got = docs.collect()
        assert sorted(tuple(r) for r in got) == sorted(want), name
        docs = spark.createDataFrame(got, docs.schema)
    assert 20 < docs.count() < spark.read.parquet(f"{plain.SMALL}/documents.parquet").count()
    want = plain.rows(packing.pack(docs))
    assert plain.rows(corpus_pipeline.run(spark, plain.SMALL)) == want


def test_every_stage_stands_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and an empty table, stage by stage."""
    docs = spark.read.parquet(f"{plain.SMALL}/documents.parquet").limit(40)
    null = docs.limit(1)
    odd = docs.unionByName(docs.limit(5))
    for c in COLUMNS:
        odd = odd.unionByName(null.withColumn(c, F.lit(None).cast(dict(docs.dtypes)[c])))
    odd.write.parquet(str(tmp_path / "odd"))
    odd = spark.read.parquet(str(tmp_path / "odd"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, plain.SMALL).count() >= 1, name
        assert stage(spark, odd.limit(0), plain.SMALL).count() == 0, name
