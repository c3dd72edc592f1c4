"""The queries against their SQL, and every stage against its own input."""

import re
from collections import defaultdict

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from ramify.llm import catalog, packing, simhash

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(connect(SMALL), catalog.QUERIES[name](spark, SMALL), catalog.ORACLES[name]) is None


def test_stages(spark):
    docs = catalog.table(spark, SMALL, "documents")
    steps = [{r.doc_id: r for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        steps.append({r.doc_id: r for r in docs.collect()})
    raw, mild, lines, distinct, clean = steps
    assert all(mild[k] == raw[k] for k in mild)
    toxic, fine = ({r.doc_id for r in catalog.table(spark, SMALL, "labels").collect() if r.toxic == x} & set(raw) for x in (1, 0))
    assert toxic and len(toxic & set(mild)) <= len(toxic) / 2 and len(fine - set(mild)) <= len(fine) / 50

    assert set(lines) == set(mild)
    seen = set()
    for k in sorted(mild):
        kept = set((lines[k].text or "").split("\n"))
        for line in (mild[k].text or "").split("\n"):
            plain = re.sub(r"[ \t\r\f\x0B]+", " ", line.translate(str.maketrans(catalog.UPPER, catalog.LOWER))).strip(" ")
            assert line in kept or len(plain) >= 20
            if len(plain) >= 20:
                assert plain not in seen or line not in kept or sum(x == line for x in (lines[k].text or "").split("\n")) == 1
                seen.add(plain)
        assert lines[k].n_chars == len(lines[k].text)

    prints = {k: simhash.fingerprint(r.text) for k, r in lines.items()}
    for a in distinct:
        assert distinct[a] == lines[a]
        assert all(a <= b or (prints[a] ^ prints[b]).bit_count() > 4 for b in distinct)
    for a in set(lines) - set(distinct):
        assert any((prints[a] ^ prints[b]).bit_count() <= 4 for b in lines if b != a)

    found = catalog.decontaminate.find_contamination(
        spark.createDataFrame(list(distinct.values()), docs.schema), catalog.table(spark, SMALL, "benchmark")
    )
    assert {r.doc_id for r in found.filter("not contaminated").collect()} == set(clean)

    pieces = defaultdict(int)
    for r in corpus_pipeline.pack(spark, docs, SMALL).collect():
        pieces[r.doc_id] += r.length
    assert set(pieces) == set(clean)


def test_planted_toxic_documents_go(spark):
    """Rows beside toxic and clean ones as the labels know them, without labels of their own."""
    folder = "/root/testdata/sf0.01"
    docs = catalog.table(spark, folder, "documents")
    marks = catalog.table(spark, folder, "labels").join(docs, "doc_id").select("toxic", "text", "lang", "source", "n_chars")
    planted = marks.orderBy("text").withColumn("doc_id", F.lit(10**9) + F.monotonically_increasing_id())
    kept = corpus_pipeline.drop_toxic(spark, docs.unionByName(planted.select(docs.columns)), folder)
    left = {r.doc_id for r in kept.filter("doc_id >= 1000000000").collect()}
    found = {r.doc_id: r.toxic for r in planted.collect()}
    assert sum(found[i] == 1 for i in left) <= 0.3 * sum(t == 1 for t in found.values())
    assert sum(i not in left for i, t in found.items() if t == 0) <= 0.02 * sum(t == 0 for t in found.values())


def test_run(spark):
    found = corpus_pipeline.run(spark, SMALL)
    assert found.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(found.columns)
    assert packing.pack(catalog.table(spark, SMALL, "documents").limit(0), catalog.tokenizer_path()).count() == 0
