"""Plain re-computations the operators are compared with."""

import itertools
import re
from collections import Counter

import xxhash


def union_find(nodes, pairs):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def simhash(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_classes(rows, max_bits=4):
    """[(id, text)] with distinct ids -> {id: (fingerprint, smallest id)}."""
    fps = {i: simhash(t) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= max_bits]
    root = union_find(list(fps), pairs)
    return {i: (f"{fps[i]:016x}", root[i]) for i in fps}


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(ws, k):
    return [tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)]


def leaks(docs, items, threshold=0.8):
    """{(doc_id, item_id): best similarity} by sliding every window."""
    out = {}
    for item_id, text in items:
        w = words(text)
        k = min(5, len(w))
        if not k:
            continue
        want = Counter(shingles(w, k))
        n = sum(want.values())
        for doc_id, body in docs:
            have = shingles(words(body), k)
            best = 0.0
            for at in range(len(have)):
                window = Counter(have[at:at + n])
                both = sum((window & want).values())
                best = max(best, both / (sum(window.values()) + n - both))
            if best >= threshold:
                out[doc_id, item_id] = best
    return out
