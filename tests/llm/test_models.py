"""BPE, token counts, language ID and quality classifier: library twins, round trips, held-out accuracy."""

import base64
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import bpe, common, language_id, quality_classifier, queries, token_counts

from . import brute

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tiktoken_encoder():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=4000):
    rnd = random.Random(1)
    parts = ["a", "b", "'s", "'t", "'re", "'ll", "'", " ", "  ", "\n", "\t", "1", "23", "!", "?!", "é", " ", "　", "x", "漢", "٣", "\x1c", "'ve", "'d", "<|endoftext|>", "\U0001f600", "\r\n", "Don't", "  'em", "Ⅷ", "²", "́"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["a" * 500, " " * 300, "ab" * 400, "\U0001f600" * 70]


def test_encoder_is_the_librarys(tiktoken_encoder):
    texts = odd_texts()
    with open(RANKS, "rb") as f:
        own = bpe.ByteBPE(bpe.load_ranks(f.read()))
    groups, _, first = own.encode(common.texts_of(pa.array(texts)))
    for t, a, b in zip(texts, first, first[1:]):
        ids = [i for g in groups[a:b] for i in g]
        assert ids == tiktoken_encoder.encode_ordinary(t) and own.decode(ids) == t.encode()


def test_digests_and_round_trip(docs, rows, nothing, tiktoken_encoder):
    out = {r.doc_id: r for r in bpe.digests(docs, RANKS, with_ids=True).collect()}
    with open(RANKS, "rb") as f:
        own = bpe.ByteBPE(bpe.load_ranks(f.read()))
    for i, t in rows:
        ids = tiktoken_encoder.encode_ordinary(t or "")
        assert bytes(own.decode(out[i].ids, out[i].starts)) == (t or "").encode()
        assert (out[i].n_tokens, out[i].ids, out[i].ids_sha256, out[i].decoded_sha256) == (len(ids), ids, brute.sha(" ".join(map(str, ids))), brute.sha(t or ""))
    coded = bpe.encode(docs, RANKS)
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(coded, RANKS).collect()} == {i: (t or "").encode() for i, t in rows}
    texts = dict(rows)
    for r in coded.collect():
        raw = (texts[r.doc_id] or "").encode()
        assert all(raw[a:b] == tiktoken_encoder.decode_single_token_bytes(i) for i, a, b in zip(r.ids, r.starts, [*r.starts[1:], len(raw)]))
    assert bpe.digests(nothing, RANKS).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, rows, nothing, name, tmp_path):
    path, cache = P.path(name), str(tmp_path / "cache")
    if name.endswith("json"):
        from tokenizers import Tokenizer

        count = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False))
    else:
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    want = sorted((i, len((t or "").encode()), count(t or "")) for i, t in rows)
    assert sorted(map(tuple, token_counts.token_counts(docs, path, cache).collect())) == want
    size = spark.read.parquet(cache).count()
    assert size == len({t or "" for _, t in rows})
    # a second run finds all of them; repeated rows return twice
    assert sorted(map(tuple, token_counts.token_counts(docs.unionByName(docs), path, cache).collect())) == sorted(want * 2)
    assert spark.read.parquet(cache).count() == size
    assert token_counts.token_counts(nothing, path, cache).count() == 0


def test_token_counts_null_ids_and_large_misses(spark, tmp_path):
    """Contents are never told apart by doc_id: null and repeated ids have texts of their own; past the bound the misses meet by a shuffle."""
    data = [(None, "one two"), (None, "one two"), (None, "three"), (1, "four five six"), (1, "four"), (1, "four"), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    want = sorted((str(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x in data)
    for bound in (100, 0):
        cache = str(tmp_path / f"cache{bound}")
        out = token_counts.token_counts(docs, JSON, cache, broadcast_misses=bound).collect()
        assert sorted((str(r[0]), r[1], r[2]) for r in out) == want and spark.read.parquet(cache).count() == 5
        more = docs.unionByName(spark.createDataFrame([(9, "seven")], docs.schema))
        assert token_counts.token_counts(more, JSON, cache, broadcast_misses=bound).count() == 8 and spark.read.parquet(cache).count() == 6


def test_parts_add_up(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    monkeypatch.setattr(token_counts, "PART_CHARS", 50)
    text = "Some words, and more of them: 12 apples\nin 3 lines  here.<|endoftext|> done " * 40
    cut = token_counts.parts(text)
    assert len(cut) > 10 and "".join(cut) == text
    assert sum(len(t.encode(p, add_special_tokens=False)) for p in cut) == len(t.encode(text, add_special_tokens=False))


def test_language_id(spark, docs, rows, nothing):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = queries.op7_language_id(spark, SF).join(truth, "doc_id").where("held_out")
    n, ok = out.select(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert n > 100 and ok > 0.98
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for i, t in rows:
        letters = any(c.isalpha() for c in t or "")
        assert (got[i].lang_pred == "und") == (not letters) and 0 <= got[i].score <= 1
    assert language_id.identify(nothing, model).count() == 0
    empty = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_language_model_sums_to_one():
    """The probabilities of all continuations of a context add up to one, seen or not."""
    import numpy as np

    letters = language_id.Letters()
    counts = {}
    for lang, text in (("aa", "abab ba bab abba " * 3), ("bb", "cab bac cc abc a " * 3)):
        codes, first = letters(common.texts_of(pa.array([text])))
        counts[lang] = np.unique(language_id.grams(codes, first), return_counts=True)
    model = language_id.build(counts)
    alphabet = [ord(c) for c in " abc"]
    for prefix in ("aba", " ba", "ccc", "bbb"):
        total = np.zeros(2)
        for c in alphabet:
            codes = np.array([*(ord(x) for x in prefix), c], np.uint64)
            a = model.entropies(codes, np.array([0, 4]))[0] * 4 - model.entropies(codes[:3], np.array([0, 3]))[0] * 3
            total += np.exp(-a)
        assert (total <= 1 + 1e-5).all() and (total > 0.7).all()


def test_quality_classifier(spark, docs, rows, nothing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = queries.op4_quality_classifier(spark, SF).join(labels, "doc_id").where("held_out")
    n, ok = out.select(F.count("*"), F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()
    assert n > 50 and ok > 0.95
    model = quality_classifier.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values()) and got[0] == got[1]
    assert quality_classifier.score(nothing, model).count() == 0
    alone = quality_classifier.train(docs, labels.limit(0))
    assert quality_classifier.score(docs, alone).count() == len(rows)
    assert quality_classifier.reject(docs, model).columns == docs.columns
    # the bounds of the sample: no indicators at all teach nothing
    none = quality_classifier.train(docs, labels, indicators=0)
    assert none.slope == 1.0 and not none.weights.any()


def test_dual_coordinate_descent_separates():
    import numpy as np

    sets = [np.array([1, 2]), np.array([1, 3]), np.array([4, 5]), np.array([4, 6])] * 5
    y = np.array([1, 1, 0, 0] * 5)
    m = quality_classifier.fit(sets, y)
    margin = lambda s: m.weights[s].sum() / np.sqrt(m.squares[s].sum()) + m.bias
    assert min(margin(s) for s, v in zip(sets, y) if v) > 0 > max(margin(s) for s, v in zip(sets, y) if not v)


def test_language_model_is_bounded(spark, monkeypatch):
    """Past the bound rare grams go, in the same way for all languages; where nothing fits, training says so."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = lambda m: sum(x.size for x in m.logp)
    whole = language_id.train(docs)
    monkeypatch.setattr(language_id, "MODEL_CELLS", size(whole) // 4)
    less = language_id.train(docs)
    assert 0 < size(less) < size(whole) and less.languages == whole.languages
    monkeypatch.setattr(language_id, "MODEL_CELLS", 1)
    with pytest.raises(ValueError):
        language_id.train(docs)
