"""Plain restatements of the operators for small tables: lists and loops, no Spark."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

WORD = re.compile("[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def targets(sizes: dict, weights=(5, 2, 1), epochs=1.5, most=2):
    """source -> target: raise the common rate a source at a time, the one that is full first."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, found = epochs * sum(sizes.values()), set(names), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * rate > most * sizes[s]]
        if not full:
            return found | {s: weight[s] * rate for s in open_}
        for s in full:
            found[s] = float(most * sizes[s])
            left -= found[s]
            open_.remove(s)
    return found


def jump(key: int, shards: int) -> int:
    state, at, nxt = key % 2**64, -1, 0
    while nxt < shards:
        at = nxt
        state = (state * 2862933555777941757 + 1) % 2**64
        nxt = int((at + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return at


def base_counts(text):
    text = text or ""
    w = words(text)
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


def quality(rows, most_documents=20, least_left=30):
    """rows of (doc_id, text, host) -> list of tuples as ``quality_rules`` returns them."""
    def normal(line):
        line = re.sub("[ \t\x0b\f\r]+", " ", line.lower().translate({ord(c): "0" for c in "123456789"}))
        return line.strip(" \t\n\x0b\f\r")

    texts = defaultdict(set)
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            if normal(line):
                texts[host, normal(line)].add(text)
    out = []
    for doc_id, text, host in rows:
        n, *rest = counts = base_counts(text)
        gone = sum(
            len(normal(x).split(" ")) for x in (text or "").split("\n")
            if normal(x) and len(texts[host, normal(x)]) > most_documents
        )
        failed = n < 20 or 100 * counts[4] > 30 * n
        out.append((doc_id, *counts, failed, not failed and not 100 * (n - gone) < least_left * n, gone))
    return out


def shingle_set(text, size=4):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def jaccard_components(rows, size=4, percent=85):
    """rows of (doc_id, text) -> list of (doc_id, n, component)."""
    sets = [shingle_set(t, size) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    common = Counter()
    for members in by.values():
        for k, i in enumerate(members):
            for j in members[:k]:
                common[j, i] += 1
    for (i, j), n in common.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            at[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = root(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def top_k(rows, k=5, every=50, scale=256):
    """rows of (vec_id, vector) -> list of (query_id, rank, vec_id, score)."""
    usable = [
        (i, np.floor(np.array(v, np.float64) * scale).astype(np.int64)) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for q, a in usable:
        if q % every:
            continue
        scored = sorted(
            ((-int(a @ b), i) for i, b in usable if i != q and len(a) == len(b)),
        )[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def warc(rows, least_bytes=0):
    """rows of (page_id, html) -> set of (page_id, bytes, digest, type, refers_to); distinct ids."""
    best = defaultdict(list)
    for i, page in rows:
        best[(page or "").encode()].append(i)
    out = []
    for i, page in rows:
        data = (page or "").encode()
        top = max(best[data])
        again = len(data) >= least_bytes and i != top
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), sha, "revisit" if again else "response", top if again else None))
    return out


def article(page):
    """The text of a page of the given tables: title and paragraphs of its article element."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S).group(1)
    body = re.sub(r"<br>|</?b>", " ", body)
    blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in blocks if x)


def crc_ids(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def planted(doc_id, w):
    """The words with the passage that every tenth document repeats."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def runs(w):
    """(start, length, period) of every run, each period tried at each place."""
    found = {}
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def run_row(doc_id, w):
    found = sorted(runs(w), key=lambda r: (r[0], r[2]))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )
