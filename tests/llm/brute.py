"""Plain versions of the operators, for small inputs."""

import hashlib
import re


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def substring_dedup(rows, length=50):
    """op2: rows (doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}; distinct doc_ids."""
    first = {}
    texts = {d: (t or "").encode() for d, t in rows}
    for d in sorted(texts):
        t = texts[d]
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], d)
    out = {}
    for d, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[d] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def window_dedup(rows, length=20):
    """op8: rows (doc_id, text) -> {doc_id: (n_words, n_removed, kept_sha256)}; distinct doc_ids."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), (d, i))
    out = {}
    for d, ws in words.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - length + 1):
            if first[tuple(ws[i : i + length])] < (d, i):
                gone[i : i + length] = [True] * length
        out[d] = (len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone, strict=True) if not g).encode()))
    return out


def simhash(text, shingle=3):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def components(rows, shingle=3, radius=3):
    """op6: rows (doc_id, text) -> {doc_id: (fingerprint, component_id)}."""
    import numpy as np

    ids = [d for d, _ in rows]
    fps = np.array([simhash(t, shingle) for _, t in rows], np.uint64)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= radius):
            a, b = top(i), top(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: (f"{int(fps[i]):016x}", least[top(i)]) for i, d in enumerate(ids)}


def canonical(text):
    import unicodedata

    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", nfkc(nfkc(text or "").casefold())).strip()


def edited(rows):
    """op10: rows (doc_id, text) -> {doc_id: (n_chars, edited_sha256, fingerprint equals the edited one's, the next one's)}."""
    rows = sorted(((d, t or "") for d, t in rows), reverse=True)
    out = {}
    for i, (d, t) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        h = len(t) // 2
        e = t[: len(t) - h] + other[:h]
        out[d] = (len(t), sha(e.encode()), float(canonical(t) == canonical(e)), float(canonical(t) == canonical(other)))
    return out


def secret_spans(text):
    """op1: the base spans and the entropy spans of a text, as (start, rank, kind, stop)."""
    import math
    from collections import Counter

    from adsentry.llm import secret_scan as S

    text, base = text or "", []
    for rank, (kind, pattern, group, least) in enumerate(
        (
            ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
            ("access", r"AKIA[A-Z0-9]+", 0, 16),
            ("hex", r"[0-9a-f]+", 0, 32),
        )
    ):
        base += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    more = []
    for m in re.finditer(S.CANDIDATE, text):
        v, w = m[0], S.WINDOW
        if any(re.search(a, v) for a in S.ALLOW):
            continue
        limit = next(bits for pattern, bits in S.CLASSES.values() if re.search(pattern, v))
        v = re.sub(S.PLACEHOLDER, lambda p: S.FILLER * len(p[0]), v)
        hot = [i for i in range(len(v) - w + 1) if S.FILLER not in v[i : i + w] and -sum(c / w * math.log2(c / w) for c in Counter(v[i : i + w]).values()) >= limit - 1e-12]
        if hot:
            a, b = m.start() + hot[0], m.start() + hot[-1] + w
            if not any(x[0] <= a and x[3] >= b for x in base):
                more.append((a, 3, "entropy", b))
    return sorted(base + more)


def leaks(docs, items, size=5, least=0.8):
    """op7: {(doc_id, item_id): similarity} over all windows, without fingerprints."""
    from collections import Counter

    def grams(words, g):
        return Counter(tuple(words[i : i + g]) for i in range(len(words) - g + 1))

    out = {}
    for item, text in items:
        own = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
        if not own:
            continue
        g = min(size, len(own))
        target = grams(own, g)
        for d, t in docs:
            words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            if len(words) < g or not set(target) & set(grams(words, g)):
                continue
            for s in range(max(1, len(words) - len(own) + 1)):
                w = grams(words[s : s + len(own)], g)
                both = sum((target & w).values())
                like = both / (sum(target.values()) + sum(w.values()) - both)
                if like >= least and like > out.get((d, item), 0):
                    out[d, item] = like
    return out
