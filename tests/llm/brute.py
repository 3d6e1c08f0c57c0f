"""Plain-Python versions of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def marked(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def covered(items, size, common):
    hit = [False] * len(items)
    for i in range(len(items) - size + 1):
        if tuple(items[i : i + size]) in common:
            hit[i : i + size] = [True] * size
    return hit


def decontaminate(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = marked(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1):
            if size:
                windows[tuple(w[i : i + size])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = marked(text), [False] * len(marked(text)), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i : i + size]))) is not None:
                    found |= own
                    hit[i : i + size] = [True] * size
        n = sum(hit)
        out.append((doc, len(w), n, len(found), sha(",".join(sorted(found))), n > 0))
    return out


def round_trip(docs, path):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(path), []
    for doc, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False))))
    return out


def quality(docs, m=10, max_covered=30, max_repeat=150):
    out = []
    for doc, text in docs:
        w = words(text)

        def repeated(k):
            count = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            return {x for x, n in count.items() if n > 1}

        seen, dups = set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dups += line in seen
                seen.add(line)
        short, cover = sum(covered(w, 3, repeated(3))), sum(covered(w, m, repeated(m)))
        failed = len(w) < 50 or 100 * short > 50 * len(w)
        kept = not failed and 100 * cover <= max_covered * len(w) and not repeated(max_repeat + 1)
        out.append((doc, len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dups, short, failed, kept))
    return out


def line_dedup(docs, min_docs=10, min_chars=1):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    count = Counter(k for _, text in docs for k in {key(x) for x in (text or "").split("\n")} if len(k) >= min_chars)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if count[key(x)] < min_docs]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def token_files(docs, path, end=1):
    from tokenizers import Tokenizer

    t, out, start = Tokenizer.from_file(path), [], 0
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def fingerprint(text):
    w = words(lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots_of(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(docs, distance=2):
    prints = [(doc, fingerprint(text)) for doc, text in docs]
    values = np.array(sorted({f for _, f in prints}), np.uint64)
    pairs = [(int(v), int(values[j])) for i, v in enumerate(values) for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ v) <= distance) + i + 1]
    root, least = roots_of([int(v) for v in values], pairs), {}
    for doc, f in prints:
        least[root[f]] = min((x for x in (least.get(root[f]), doc) if x is not None), default=None)
    return [(doc, f"{f:016x}", least[root[f]]) for doc, f in prints]


def repeated_bytes(docs, size=400):
    data = [(text or "").encode() for _, text in docs]
    count = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for (doc, _), d in zip(docs, data):
        hit, reach = [], 0
        for i in range(len(d)):
            if i + size <= len(d) and count[d[i : i + size]] > 1:
                reach = i + size
            hit.append(i < reach)
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out.append((doc, len(d), sum(hit), spans, sha(bytes(b for b, h in zip(d, hit) if not h))))
    return out


def repeated_words(docs, size=35):
    lists = [words(text) for _, text in docs]
    count = Counter(tuple(w[i : i + size]) for w in lists for i in range(len(w) - size + 1))
    common = {x for x, n in count.items() if n > 1}
    out = []
    for (doc, _), w in zip(docs, lists):
        hit = covered(w, size, common)
        out.append((doc, len(w), sum(hit), sha(" ".join(x for x, h in zip(w, hit) if not h))))
    return out
