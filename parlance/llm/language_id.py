"""Language identification by interpolated Kneser-Ney character models.

A model per language over 4-grams of lower-case letters and word ends. The seen
grams of all languages share one table a level: a sorted array of 64-bit hashes
and, beside it, log probabilities by language; contexts have their back-off
weights in the same form. A text goes to the language of the lowest cross-entropy
per character. Its score is calibrated, and texts unlike any language are flagged.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import Texts, mix, pieces, texts_of, written

ORDER = 4
BLANK = 0x20
#: Learned from about so many documents a language; documented bound of the sample.
DOCS_PER_LANGUAGE = 3000
#: Languages whose counts are broadcast at most.
BROADCAST_LANGUAGES = 10_000
#: Numbers of the model at most, four bytes each, which is broadcast; rarer grams go until it fits.
MODEL_CELLS = 64_000_000
UNDETERMINED = "und"


class Letters:
    """Lower-case letters of texts; each run of other characters counts as one blank."""

    def __init__(self) -> None:
        self.known, self.fold = np.zeros(0x110000, bool), np.zeros(0x110000, np.uint16)

    def __call__(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """16-bit codes, and the first code of each text (n + 1 entries)."""
        if not len(t.data):
            return np.zeros(0, np.uint64), np.zeros(len(t) + 1, np.int64)
        points = np.frombuffer(t.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        if not self.known[points].all():
            for p in np.unique(points[~self.known[points]]).tolist():
                c = chr(p)
                low = ord(c.lower()[0])
                self.fold[p] = (low if low < 0xFFFE else 0xFFFE) if unicodedata.category(c)[0] == "L" else BLANK
                self.known[p] = True
        codes = self.fold[points]
        lead = np.flatnonzero((t.data & 0xC0) != 0x80)
        starts = np.searchsorted(lead, t.offsets)
        letter = codes != BLANK
        stay = letter.copy()
        stay[1:] |= letter[:-1]
        inner = starts[(starts > 0) & (starts < len(points))]
        stay[inner] = letter[inner]
        return codes[stay].astype(np.uint64), np.concatenate([[0], np.cumsum(stay)])[starts]


def grams(codes: np.ndarray, first: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The packed gram that ends at each code; blanks stand before a text."""
    n = len(codes)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    out = codes.copy()
    for k in range(1, order):
        before = np.full(n, BLANK, np.uint64)
        before[k:] = codes[:-k] if k < n else 0
        before[place < k] = BLANK
        out |= before << np.uint64(16 * k)
    return out


def _low(x: np.ndarray, k: int) -> np.ndarray:
    """The last k codes of packed grams."""
    return x & np.uint64((1 << (16 * k)) - 1) if k < 4 else x


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # by level 1..ORDER: sorted hashes of seen grams
    logp: list[np.ndarray]  # by level: float32 of grams by language
    contexts: list[np.ndarray]  # by level 1..ORDER - 1: sorted hashes of contexts of so many codes
    backoff: list[np.ndarray]
    unseen: float
    sharpness: float = 1.0
    worst: np.ndarray | None = None  # by language: cross-entropy beyond which a text is unlike it

    def entropies(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Cross-entropy per character by text and language; 0 for texts without letters."""
        langs, n = len(self.languages), len(codes)
        out = np.zeros((len(first) - 1, langs))
        if not n:
            return out
        full = grams(codes, first)
        total = np.zeros((n, langs), np.float32)
        todo = np.arange(n)
        for level in range(ORDER, 0, -1):
            g = _low(full[todo], level)
            hit, at = _find(self.keys[level - 1], mix(g + np.uint64(level)))
            total[todo[hit]] += self.logp[level - 1][at[hit]]
            todo, g = todo[~hit], g[~hit]
            if not len(todo):
                break
            if level > 1:
                seen, at = _find(self.contexts[level - 2], mix((g >> np.uint64(16)) + np.uint64(level - 1)))
                total[todo[seen]] += self.backoff[level - 2][at[seen]]
            else:
                total[todo] += self.unseen
        sums = np.concatenate([np.zeros((1, langs)), np.cumsum(total, axis=0, dtype=np.float64)])
        n_codes = np.diff(first)
        return -(sums[first[1:]] - sums[first[:-1]]) / np.maximum(n_codes, 1)[:, None]

    def posterior(self, entropy: np.ndarray, n_codes: np.ndarray) -> np.ndarray:
        z = -entropy * (self.sharpness * np.sqrt(np.maximum(n_codes, 1)))[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def _one_language(gram: np.ndarray, count: np.ndarray, unseen: float) -> tuple[list, list]:
    """By level: (grams, probabilities) and (contexts, back-off weights), both sorted by packed value."""
    levels = {ORDER: (gram, count.astype(np.float64))}
    for k in range(ORDER - 1, 0, -1):  # how many different characters precede
        g, c = np.unique(_low(levels[k + 1][0], k), return_counts=True)
        levels[k] = (g, c.astype(np.float64))
    probs, weights = [], []
    for k in range(1, ORDER + 1):
        g, c = levels[k]
        once, twice = (c == 1).sum(), (c == 2).sum()
        d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
        ctx, at = np.unique(g >> np.uint64(16) if k > 1 else np.zeros(len(g), np.uint64), return_inverse=True)
        total, kinds = np.bincount(at, c), np.bincount(at)
        gamma = d * kinds / total
        if k == 1:
            lower = np.full(len(g), np.exp(unseen))
        else:
            lower = probs[-1][1][np.searchsorted(probs[-1][0], _low(g, k - 1))]
        probs.append((g, np.maximum(c - d, 0) / total[at] + gamma[at] * lower))
        weights.append((ctx, gamma))
    return probs, weights


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """counts: sorted packed grams and their counts by language."""
    languages = sorted(counts)
    letters = np.unique(np.concatenate([_low(g, 1) for g, _ in counts.values()] or [np.zeros(0, np.uint64)]))
    unseen = -float(np.log(len(letters) + 1))
    made = [_one_language(*counts[x], unseen) for x in languages]
    keys, logp, contexts, backoff = [], [], [], []
    before, all_before = None, None
    for k in range(1, ORDER + 1):
        union = np.unique(np.concatenate([p[k - 1][0] for p, _ in made]))
        table = np.empty((len(union), len(languages)), np.float32)
        for j, (p, w) in enumerate(made):
            if k == 1:
                gamma = float(w[0][1][0]) if len(w[0][1]) else 1.0
                rest = np.full(len(union), unseen + np.log(gamma))
            else:
                seen, at = _find(w[k - 1][0], union >> np.uint64(16))
                rest = np.where(seen, np.log(w[k - 1][1][at] if len(w[k - 1][1]) else 1.0), 0.0)
                rest = rest + before[np.searchsorted(all_before, _low(union, k - 1)), j]
            seen, at = _find(p[k - 1][0], union)
            table[:, j] = np.where(seen, np.log(p[k - 1][1][at]), rest)
        before, all_before = table, union
        h = mix(union + np.uint64(k))
        order = np.argsort(h)
        keys.append(h[order])
        logp.append(table[order])
        if k > 1:
            ctx = np.unique(np.concatenate([w[k - 1][0] for _, w in made]))
            weight = np.zeros((len(ctx), len(languages)), np.float32)
            for j, (_, w) in enumerate(made):
                weight[np.searchsorted(ctx, w[k - 1][0]), j] = np.log(w[k - 1][1])
            h = mix(ctx + np.uint64(k - 1))
            order = np.argsort(h)
            contexts.append(h[order])
            backoff.append(weight[order])
    return Model(languages, keys, logp, contexts, backoff, unseen)


def _least_count(found: DataFrame) -> int:
    """How often a gram must occur so that the model, a number for each gram and language, stays within MODEL_CELLS: once, if it fits."""
    sizes = {r["n"]: r["count"] for r in found.groupBy(F.least("n", F.lit(64)).alias("n")).count().collect()}  # 64 rows at most
    langs = found.select("lang").distinct().count()
    for least in range(1, 65):
        if sum(v for n, v in sizes.items() if n >= least) * langs <= MODEL_CELLS:
            return least
    raise ValueError(f"a model of {langs} languages doesn't fit: learn fewer languages, or fewer documents of each")


def _counts(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Gram counts by language: summed in each task, then over the tasks. rows: (lang, text), a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for b in pieces(batches):
            langs = b.column(0).to_numpy(zero_copy_only=False)
            codes, first = letters(texts_of(b.column(1)))
            of = np.repeat(np.arange(b.num_rows), np.diff(first))
            names, which = np.unique(langs.astype(str), return_inverse=True)
            g = grams(codes, first)
            for j, name in enumerate(names):
                u, c = np.unique(g[which[of] == j], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(c)], names=["lang", "gram", "n"])

    found = written(rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    least = _least_count(found)
    found = found.where(F.col("n") >= least).toPandas()  # MODEL_CELLS rows at most
    out = {}
    for lang, part in found.groupby("lang"):
        g = part["gram"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(g)
        out[str(lang)] = (g[order], part["n"].to_numpy()[order])
    return out


def _sample(rows: DataFrame, per_language: int, seed: int) -> DataFrame:
    """About `per_language` rows of each language, by a hash of doc_id: no sort, no group in one task."""
    n = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    # few languages are broadcast, so that texts stay where they are; beyond the bound the join shuffles
    n = F.broadcast(n) if n.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES else n
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    return rows.join(n, "lang").where(place < F.lit(float(1 << 30)) * F.lit(per_language) / F.col("__n")).select("lang", "text")


def train(rows: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """rows: doc_id, lang, text, of which a quarter calibrates. Null languages and texts teach nothing.

    Without any usable row the model has no languages, and every text is undetermined.
    """
    rows = rows.select("doc_id", "lang", "text").where("lang is not null and text is not null")
    aside = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0
    counts = _counts(_sample(rows.where(~aside), per_language, 1)) or _counts(_sample(rows, per_language, 1))
    counts = {k: v for k, v in counts.items() if len(v[0])}
    if not counts:
        return Model([], [], [], [], [], 0.0)
    model = build(counts)
    # the driver gets a number for each of these texts and language: fewer texts a language where there are many
    each = min(max(200, per_language // 4), max(1, MODEL_CELLS // 4 // len(model.languages) ** 2))
    return calibrated(model, _sample(rows.where(aside), each, 2))


def calibrated(model: Model, rows: DataFrame) -> Model:
    """The sharpness of the likeliest posterior, and each language's rejection limit, from rows not learned from."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    at = {x: i for i, x in enumerate(model.languages)}
    langs = len(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, m = Letters(), sent.value
        for b in pieces(batches):
            codes, first = letters(texts_of(b.column(1)))
            h = m.entropies(codes, first).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first)), pa.array(h.tolist(), pa.list_(pa.float32()))], names=["lang", "n", "h"])

    got = rows.mapInArrow(run, "lang string, n long, h array<float>").where("n > 0").toPandas()
    got = got[got["lang"].isin(at)]
    model.worst = np.full(langs, np.inf)
    if not len(got):
        return model
    h, n, y = np.stack(got["h"].to_numpy()), got["n"].to_numpy(), got["lang"].map(at).to_numpy()
    best = -np.inf
    for s in np.geomspace(0.05, 20, 40):
        model_s = Model(model.languages, [], [], [], [], 0.0, s)
        fit = np.log(np.maximum(model_s.posterior(h, n)[np.arange(len(y)), y], 1e-9)).mean()
        if fit > best + 1e-9:
            best, model.sharpness = fit, float(s)
    for j in range(langs):
        if (own := h[y == j, j]).size >= 20:
            model.worst[j] = np.quantile(own, 0.995) + 3 * own.std()
    return model


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, lang_pred, score (0 to 1) and rejected (unlike every language learned).

    A null text, or one without a letter, is `und` with score 0. Ties go to the
    language first by name. Repeated rows give repeated rows.
    """
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, m = Letters(), sent.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for b in pieces(batches, "__text"):
            codes, first = letters(texts_of(b.column(len(keep))))
            n = np.diff(first)
            if m.languages:
                h = m.entropies(codes, first)
                p = m.posterior(h, n)
                best = h.argmin(axis=1)
                score, low = p[np.arange(len(n)), best], h[np.arange(len(n)), best]
                odd = low > (m.worst[best] if m.worst is not None else np.inf)
            else:
                best, score, odd = np.zeros(len(n), int), np.zeros(len(n)), np.ones(len(n), bool)
            none = (n == 0) | (not m.languages)
            best = np.where(none, len(m.languages), best)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(names[best], pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(odd | none)], names=[*keep, "lang_pred", "score", "rejected"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{types}, lang_pred string, score double, rejected boolean")
