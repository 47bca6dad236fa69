"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

import hashlib

import corpus_pipeline
from parlance.llm.common import written

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    after = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "t")
        after.append(docs)
    read = lambda d: [(r.doc_id, r.text) for r in d.collect()]
    first, near, cut, clean = (read(d) for d in after[:4])
    assert all(d.columns == columns for d in after[:4])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in first}
    good = [i in kept for i, q in labels.items() if q == 1]
    bad = [i in kept for i, q in labels.items() if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)
    assert {i for i, _ in near} == {c for _, c, _ in brute.op9(first)}
    want = {r[0]: r for r in brute.op3(near)}
    assert len(cut) == len(near) and all(brute.sha(" ".join(brute.SPACE_WORD.findall(t))) == want[i][3] for i, t in cut)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in clean) == sorted(r[0] for r in brute.op6(cut, items) if not r[5])
    texts = dict(clean)
    last = after[4].collect()
    assert sorted(r.doc_id for r in last) == sorted(texts)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in last)


def odd_rows(spark):
    """The real documents with clashing columns, and rows with nulls, no words, copies, shared ids and a very long text."""
    from pyspark.sql import functions as F

    real = spark.read.parquet(f"{SF}/documents.parquet")
    more = {"key": F.lit("k"), "score": F.lit(1), "n": F.col("doc_id"), "row": F.lit(None).cast("string"), "kind": F.lit(2), "slot": F.lit("s"), "__rowa": F.lit(3), "k0": F.lit(4)}
    real = real.withColumns(more)
    base = real.orderBy("doc_id").first().asDict()
    own = lambda **x: tuple((base | x)[c] for c in real.columns)
    plain = " ".join(f"plain{i} word{i % 9}" for i in range(200))
    rows = [own(doc_id=None, text=None, lang=None, source=None, n_chars=None), own(doc_id=900001, text=""), own(doc_id=900001, text=""), own(doc_id=900002, text=plain), own(doc_id=900002, text=plain), own(doc_id=900002, text=plain + " other"), own(doc_id=None, text=plain), own(doc_id=900003, text=" ".join(f"long{i}" for i in range(300_000)))]
    return real.unionByName(spark.createDataFrame(rows, real.schema))


def test_stages_on_odd_rows(spark):
    docs = written(odd_rows(spark), "t")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        new = written(stage(spark, docs, SF), "t")
        assert name == "byte_bpe" or new.columns == columns
        sizes.append((docs.count(), new.count()))
        if name == "ngram_join":
            ids = [r.doc_id for r in new.where("doc_id >= 900000 or doc_id is null").collect()]
            assert ids.count(900002) <= 1 and ids.count(900001) <= 1
        if name in ("substring_dedup", "byte_bpe"):
            assert sizes[-1][0] == sizes[-1][1]
        docs = new
    assert sizes[-1][1] > 0


def test_stages_on_an_empty_table(spark):
    docs = odd_rows(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "t")
        assert docs.count() == 0
