"""Substring dedup and suffix-array dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import common, exchange, substring_dedup, suffix_dedup

from . import brute


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def mosaics(seed, alphabet, n=40, pieces=4, longest=120):
    """Texts put together from shared pieces."""
    rnd = random.Random(seed)
    base = [[rnd.randrange(alphabet) for _ in range(rnd.randint(0, longest))] for _ in range(10)]
    out = []
    for i in range(n):
        d = []
        for _ in range(rnd.randint(0, pieces)):
            b = rnd.choice(base)
            x = rnd.randint(0, len(b))
            d += b[x : rnd.randint(x, len(b))]
        out.append((i, " ".join(f"w{x}" for x in d)))
    return out


def test_xxhash(spark):
    ids = [0, 1, -1, 12345678901234, -(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("xxhash64(i) h").collect()
    assert [r.h for r in rows] == exchange.xxhash64(np.array(ids)).tolist()


@pytest.mark.parametrize("seed", range(12))
def test_equal_windows_have_equal_anchors(seed):
    docs = mosaics(seed, [2, 3, 6, 50, 1000][seed % 5])
    e = substring_dedup.find(common.texts_of(pa.array([t for _, t in docs])))
    words, of, seen = [t.split() for _, t in docs], {}, 0
    for d, lo, hi, a in zip(e.doc.tolist(), e.lo.tolist(), e.hi.tolist(), e.anchor.tolist()):
        for p in range(lo, hi + 1):
            seen += 1
            assert of.setdefault(tuple(words[d][p : p + 20]), a) == a
    assert seen == sum(max(0, len(w) - 19) for w in words)


COLS3, COLS10 = ["doc_id", "n_words", "n_removed", "kept_sha256"], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_substring_dedup(spark, docs, rows, real, nothing):
    assert got(substring_dedup.report(docs), *COLS3) == sorted(brute.op3(rows))
    assert got(substring_dedup.report(real), *COLS3) == sorted(brute.op3(pairs(real)))
    assert substring_dedup.report(nothing).count() == 0
    for seed in (1, 2):
        some = mosaics(seed, 3 if seed == 1 else 1000, 150)
        df = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
        assert got(substring_dedup.report(df), *COLS3) == sorted(brute.op3(some))


def test_hot_anchors(spark, monkeypatch):
    """With every anchor of two contexts in a batch counted as hot, in some batches and not in others."""
    monkeypatch.setattr(exchange, "HOT_CONTEXTS", 1)
    passage = " ".join(f"p{i}x" for i in range(100))
    some = mosaics(7, 40, 150) + [(1000 + i, f"a{i}b c{i}d {passage} e{i}f g{i}h " + "tail " * (i % 4)) for i in range(60)]
    for parts in (1, 7):
        df = spark.createDataFrame(some, "doc_id long, text string").repartition(parts)
        assert got(substring_dedup.report(df), *COLS3) == sorted(brute.op3(some))
        assert got(suffix_dedup.report(df), *COLS10) == sorted(brute.op10(some))


def test_substring_texts(docs, rows):
    out = {r.doc_id: r for r in substring_dedup.deduplicate(docs).collect()}
    want = {r[0]: r for r in brute.op3(rows)}
    assert substring_dedup.deduplicate(docs).columns == docs.columns and len(out) == len(rows)
    for i, t in rows:
        assert brute.sha(" ".join(brute.SPACE_WORD.findall(out[i].text))) == want[i][3]
        assert want[i][2] or out[i].text == (t or "")


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    other = text + " tail"
    df = spark.createDataFrame([(5, text), (5, text), (5, other), (None, text), (7, None)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.report(df).collect()), key=str)
    assert out == [(5, 30, 30), (5, 30, 30), (5, 31, 30), (7, 0, 0), (None, 30, 0)] or out[:3] == [(5, 30, 30), (5, 30, 30), (5, 31, 30)]
    df = spark.createDataFrame([(5, "q" + "abcd" * 10 + "x" * 500), (5, "q" + "abcd" * 10 + "x" * 500)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.report(df).collect()] == [541, 541]


def test_suffix_core():
    rnd = random.Random(5)
    for _ in range(80):
        letters = rnd.choice([1, 2, 4, 26])
        base = [bytes(rnd.randrange(letters) + 97 for _ in range(rnd.randint(0, 60))) for _ in range(4)]
        texts = []
        for _ in range(rnd.randint(1, 9)):
            d = b""
            for _ in range(rnd.randint(0, 3)):
                b = rnd.choice(base)
                i = rnd.randint(0, len(b))
                d += b[i : rnd.randint(i, len(b))]
            texts.append(d)
        k = rnd.randint(1, 20)
        c = Counter(t[p : p + k] for t in texts for p in range(len(t) - k + 1))
        want = [[c[t[p : p + k]] > 1 for p in range(max(0, len(t) - k + 1))] for t in texts]
        assert want == [x.tolist() for x in suffix_dedup.repeated_starts([np.frombuffer(t, np.uint8) for t in texts], k)]


@pytest.mark.parametrize("most", [256, 1])
def test_suffix_dedup(spark, docs, rows, real, nothing, most, monkeypatch):
    """Also with every core counted as hot."""
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    assert got(suffix_dedup.report(docs), *COLS10) == sorted(brute.op10(rows))
    assert got(suffix_dedup.report(real), *COLS10) == sorted(brute.op10(pairs(real)))
    assert suffix_dedup.report(nothing).count() == 0
    some = mosaics(4, 300, 120, 3, 250)
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
    assert got(suffix_dedup.report(df), *COLS10) == sorted(brute.op10(some))


def test_suffix_texts(docs, rows):
    want = {r[0]: r for r in brute.op10(rows)}
    for r in suffix_dedup.deduplicate(docs).collect():
        assert want[r.doc_id][2] or r.text == (dict(rows)[r.doc_id] or "")


def test_suffix_passages_at_the_length(spark):
    """Repeated passages of over 50 words go at 400 bytes, the blanks around them included, and stay at 399, however many words they have."""
    some, left = [], {}
    for k, (n, size) in enumerate([(51, 397), (60, 397), (51, 398), (60, 398)]):
        passage = " ".join(f"p{k}w{i}" for i in range(n))
        passage += "x" * (size - len(passage))
        for h, c in enumerate("abc"):
            i, before, after = 10 * k + h, f"own{k}{h} text{c}", f"{c}tail own{h}{k}"
            some.append((i, f"{before} {passage} {after}"))
            left[i] = (0, some[-1][1]) if size < 398 else (size + 2, before + after)
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
    out = suffix_dedup.report(df, texts=True)
    assert {r.doc_id: (r.n_removed, r.text) for r in out.collect()} == left
    assert got(out, *COLS10) == sorted(brute.op10(some))


@pytest.mark.parametrize("hot", [False, True])
def test_forced_collisions(spark, monkeypatch, hot):
    """Where the first hash of contexts or of windows has four values alone, the second tells them apart."""
    few = lambda x: x & np.uint64(3)
    if hot:
        monkeypatch.setattr(exchange, "HOT_CONTEXTS", 1)
        monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", 1)
    find3, find10, ask3, ask10 = substring_dedup.find, suffix_dedup.find, substring_dedup.ask, suffix_dedup.ask

    def weak(find):
        def run(t):
            e = find(t)
            return exchange.Entries(e.doc, e.lo, e.hi, e.anchor, few(e.ctx), e.check)

        return run

    def weak_windows(ask):
        def run(*args):
            bucket, cols, *rest = ask(*args)
            windows = cols["len"] == 0 if "len" in cols else np.ones(len(bucket), bool)
            cols["hash"] = np.where(windows, few(cols["hash"]), cols["hash"])
            return np.where(windows, few(cols["hash"]).astype(np.int64), bucket), cols, *rest

        return run

    some = mosaics(9, 40, 120)
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
    for module, find, ask, cols, want in ((substring_dedup, find3, ask3, COLS3, brute.op3), (suffix_dedup, find10, ask10, COLS10, brute.op10)):
        op = module.OPERATOR
        weaker = exchange.Repeats(weak(find), op.settle, weak_windows(ask), op.resolve, op.finish, op.same_place_counts, op.repeated)
        monkeypatch.setattr(module, "OPERATOR", weaker)
        assert got(module.report(df), *cols) == sorted(want(some))
