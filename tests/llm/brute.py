"""Plain versions of the operators, straight from their contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def roots(n, pairs):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def near_duplicates(docs, least=85):
    """docs: (doc_id, text). Rows (doc_id, n_shingles, component_id, kept); ids are unique and not null."""
    sets = []
    for _, text in docs:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    pairs = []
    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x] if j > k)
        pairs += [(k, j) for j, c in common.items() if 100 * c >= least * (len(s) + len(sets[j]) - c)]
    root = roots(len(docs), pairs)
    least_id = {}
    for k, r in enumerate(root):
        least_id[r] = min(docs[k][0], least_id.get(r, docs[k][0]))
    return sorted((d, len(s), least_id[r], d == least_id[r]) for (d, _), s, r in zip(docs, sets, root))


def bytes_removed(docs, length=400):
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), len(b) - len(kept), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def words_removed(docs, length=20):
    """Rows (doc_id, n_words, n_removed, kept_sha256)."""
    first, split = {}, [(d, words(t)) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - length + 1):
            x = tuple(w[i : i + length])
            first[x] = min(first.get(x, (d, i)), (d, i))
    out = []
    for d, w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (d, i):
                gone[i : i + length] = True
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def vector_links(vectors, least=0.9):
    """Pairs of rows of (vec_id, embedding) with a cosine of ``least`` or more."""
    good = [k for k, (_, v) in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    if not good:
        return set()
    x = np.array([vectors[k][1] for k in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
    return {(good[i], good[j]) for i, j in zip(a.tolist(), b.tolist())}


def targets(sizes, most=3):
    """Target of each source: resharing what is above the ceiling until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}
