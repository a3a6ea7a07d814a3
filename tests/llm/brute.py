"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
from collections import defaultdict


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def substring(rows: list[tuple], width: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, sha256 of the kept words) of (doc_id, text)."""
    key = lambda i: (1, 0) if i is None else (0, i)
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict[tuple, tuple] = {}
    for i, w in words:
        for p in range(len(w) - width + 1):
            g = tuple(w[p : p + width])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < key(i):
                gone |= set(range(p, p + width))
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def suffix(rows: list[tuple], width: int) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, sha256 of the bytes that are left)."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    count: dict[bytes, int] = defaultdict(int)
    for _, t in texts:
        for p in range(len(t) - width + 1):
            count[t[p : p + width]] += 1
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - width + 1):
            if count[t[p : p + width]] > 1:
                gone[p : p + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def near(rows: list[tuple], width: int) -> list[tuple]:
    """(doc_id, fingerprint, smallest id reached)."""
    import xxhash

    fps = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                group[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, f"{fps[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows)]


def similar(rows: list[tuple], width: int) -> list[tuple]:
    """(doc_id, smallest id reached) by links of shingle sets at a Jaccard similarity of 0.8; empty sets are equal."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    near = lambda p, q: 5 * len(p & q) >= 4 * len(p | q)
    least = {i: i for i in range(len(rows))}
    beside = [[j for j in range(len(rows)) if near(sets[i], sets[j])] for i in range(len(rows))]
    for _ in rows:  # least label until nothing changes
        least = {i: min((least[j] for j in beside[i]), key=lambda j: (rows[j][0] is None, rows[j][0] or 0)) for i in least}
    return [(d, rows[least[i]][0]) for i, (d, _) in enumerate(rows)]


def compression_bands(rows: list[tuple], bands: tuple) -> dict:
    """By doc_id: base counts, base_failed, kept, ratio, chunks outside their band, chunks and reason, of (doc_id, text)."""
    import math
    from collections import Counter
    from statistics import quantiles

    import zstandard

    size = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))
    found, ratios = {}, defaultdict(list)

    def chunks(x: bytes) -> list[bytes]:
        whole = [x[j : j + 1024] for j in range(0, len(x) - 1023, 1024)]
        return whole + ([x[-1024:]] if len(x) % 1024 else [])

    for i, t in rows:
        raw = (t or "").encode()
        words = raw.split()
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
        lines = [x for x in raw.split(b"\n") if x.split()]
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        symbols = sum(raw.count(c.encode()) for c in "#*$%&|<>")
        found[i] = raw, [len(words), sum(len(w.decode()) for w in words), symbols, len(lines) - len(set(lines)), len(repeated), failed]
        if not failed:
            ratios[math.floor(4 * math.log2(len(raw)))].append(round(size(raw), 3))
            ratios["chunk"] += [round(size(x), 3) for x in chunks(raw) if len(x) == 1024]

    def inside(x: bytes, full: bool = False) -> bool | str:
        low, high = next(b[1:] for b in bands if len(x) < b[0])
        own = ratios["chunk" if full else math.floor(4 * math.log2(len(x)))] if x else []
        if len(own) >= 32:
            a, b, c = quantiles(own, n=4, method="inclusive")
            spread = max((c - a) / 1.349, b / 100)
            low, high = max(low, b - 6 * spread), min(high, b + 4 * spread)
        return "incompressible" if (size(x) if x else 0) < low else "repetitive" if x and size(x) > high else True

    out = {}
    for i, (raw, base) in found.items():
        parts = chunks(raw)
        bad = sum(inside(x, len(x) == 1024) is not True for x in parts)
        whole = inside(raw)
        reason = "base" if base[-1] else whole if whole is not True else "chunks" if bad and 4 * bad >= len(parts) else None
        out[i] = (*base, reason is None, size(raw) if raw else 0.0, bad, len(parts), reason)
    return out
