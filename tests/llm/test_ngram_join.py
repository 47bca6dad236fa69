"""N-gram Jaccard join against brute force."""

import random

import pytest

from parlance.llm import ngram_join

from . import brute


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "class_id", "n_links").collect())


def near_copies(seed=3, n=40):
    rnd = random.Random(seed)
    out = []
    for g in range(6):
        base = [f"g{g}w{rnd.randrange(10**6)}" for _ in range(rnd.randint(30, 300))]
        for _ in range(rnd.randint(1, n)):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(w))
    rnd.shuffle(out)
    return list(enumerate(out))


def test_bands():
    b = ngram_join.bands_for(0.8, 0.99999, 5)
    assert (1 - 0.8**5) ** b <= 1e-5 < (1 - 0.8**5) ** (b - 1)


@pytest.mark.parametrize("block", [512, 7])
def test_join(spark, docs, rows, real, nothing, block):
    assert got(ngram_join.join(docs, block=block)) == sorted(brute.op9(rows))
    some = near_copies()
    assert got(ngram_join.join(spark.createDataFrame(some, "doc_id long, text string").repartition(4), block=block)) == sorted(brute.op9(some))
    if block == 512:
        pairs = [(r[0], r[1]) for r in real.select("doc_id", "text").collect()]
        assert got(ngram_join.join(real)) == sorted(brute.op9(pairs))
        assert ngram_join.join(nothing).count() == 0


def test_one_of_each(docs, rows):
    kept = ngram_join.one_of_each(docs)
    want = {c for _, c, _ in brute.op9(rows)}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_components(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z2"), ("z3", "z2"), ("a", "a")]
    out = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(chain, "u string, v string")).collect()}
    assert out == {f"n{i:03}": "n000" for i in range(61)} | {"z1": "z1", "z2": "z1", "z3": "z1"}


def test_one_of_each_by_row(spark):
    """Rows that share a doc_id, equal rows, null ids and texts without words, with a column that clashes."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near = a.replace("a39", "other")
    data = [(1, a, "x"), (1, a, "x"), (2, a, "x"), (1, b, "x"), (3, near, "y"), (None, a, "z"), (None, "null one here too many", "z"), (None, "null one here too many", "w"), (7, None, "x"), (7, None, "x"), (8, "", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, `__rowa` string").repartition(3)
    out = sorted(map(str, ((r[0], r[1], r[2]) for r in ngram_join.one_of_each(docs).collect())))
    fixed = [(1, b, "x"), (7, None, "x"), (8, "", "x")]
    assert len(out) == 5 and set(map(str, fixed)) <= set(out)
    assert str((1, a, "x")) in out and sum("null one" in x for x in out) == 1


def test_chain_of_unlike_texts_is_no_component(spark):
    """Texts of which each shares 0.4 with the next meet in bands, but their MinHashes don't agree: nothing is linked."""
    words = [f"c{i}" for i in range(12000)]
    chain = [" ".join(words[i * 38 : i * 38 + 100]) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    bands = ngram_join.bands_for(0.8, ngram_join.RECALL, 5)
    least = ngram_join.least_agreeing(0.8, ngram_join.RECALL, bands * 5)
    per_class = ngram_join.classes(docs, 5, bands, 5)
    banded = per_class.select("key", ngram_join.F.explode("bands").alias("b"))
    met = banded.groupBy("b").count().where("count > 1").count()
    assert met > 50 and ngram_join.band_links(per_class, least, 512).count() == 0
    assert got(ngram_join.join(docs)) == sorted(brute.op9(list(enumerate(chain))))


def test_recall_at_the_threshold():
    """Of pairs of similarity 0.8, all share a band and agree in enough MinHashes."""
    import numpy as np

    rnd = np.random.default_rng(5)
    bands = ngram_join.bands_for(0.8, ngram_join.RECALL, 5)
    least = ngram_join.least_agreeing(0.8, ngram_join.RECALL, bands * 5)
    n, found = 2000, 0
    h = [np.sort(x) for _ in range(n) for s in [rnd.integers(0, 2**63, 110, dtype=np.uint64)] for x in (s[:99], np.concatenate([s[11:99], s[99:]]))]
    sig, sketch = ngram_join.signatures(np.concatenate(h), np.arange(0, 99 * (2 * n + 1), 99), bands, 5)
    shared = (sig[::2] == sig[1::2]).any(axis=1)
    agree = (sketch[::2] == sketch[1::2]).sum(axis=1)
    assert shared.all() and (agree >= least).all()


def test_parts_of_a_band():
    import numpy as np

    group = np.array([0, 0, 0, 0, 1, 1, 2])
    sketch = np.array([[1, 1, 1, 1], [9, 9, 9, 9], [9, 9, 9, 8], [1, 1, 1, 2], [5, 5, 5, 5], [6, 6, 6, 6], [1, 1, 1, 1]], np.uint8)
    assert ngram_join.agreeing_parts(group, sketch, 3).tolist() == [0, 1, 1, 0, 4, 5, 6]
