"""The operators' contracts, written plainly: for small tables only."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def alnum(text):
    return ALNUM_WORD.findall((text or "").translate(UPPER))


def op1(docs):
    out = []
    for i, text in docs:
        text = text or ""
        w = SPACE_WORD.findall(text)
        lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = Counter(windows)
        hit = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed))
    return out


def op3(docs, k=20):
    """docs: distinct ids."""
    words = {i: SPACE_WORD.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][p : p + k]), (i, p))
    out = []
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < (i, p):
                gone.update(range(p, p + k))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def op6(docs, items):
    at = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        for p in range(len(w) - 12 if len(w) >= 13 else min(1, len(w))):
            at[tuple(w[p : p + 13])].add(str(item))
    lens = {len(x) for x in at}
    out = []
    for i, text in docs:
        w, hit, found = alnum(text), set(), set()
        for n in lens:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p : p + n])) in at:
                    hit.update(range(p, p + n))
                    found |= at[x]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def op8(docs):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    out = []
    for i, text in docs:
        w = alnum(text)
        at = [(p, label) for x, label in phrases.items() for p in range(len(w)) if w[p : p + len(x.split())] == x.split()]
        starts = [p for p, _ in at]
        out.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    return out


def shingles(text, k=5):
    w = SPACE_WORD.findall(text or "")
    return {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def op9(docs, least=0.8):
    """class (smallest id of the connected component) and links by id."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        low[find(a)].append(i)
    return [(i, min(low[find(a)]), links[a]) for a, (i, _) in enumerate(sets)]


def op10(docs, k=400):
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, b in raw:
        seen.update(b[p : p + k] for p in range(len(b) - k + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - k + 1):
            if seen[b[p : p + k]] > 1:
                gone[p : p + k] = b"\1" * k
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out
