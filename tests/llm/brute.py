"""Plain Python versions of the operators' contracts."""

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

UP = {c: c + 32 for c in range(65, 91)}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def contamination(text, items):
    """items: (id, text) pairs. n_words, n_hit, sorted ids, contaminated."""
    w, hit, found = bench_words(text), set(), set()
    for item, t in items:
        v = bench_words(t)
        n = min(13, len(v))
        for i in range(len(v) - n + 1 if v else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[i : i + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    w = blank_words((text or "").translate(UP))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(fps, distance=2):
    """fps: id -> fingerprint. id -> least id of its component."""
    by = defaultdict(list)
    for i, f in fps.items():
        by[f].append(i)
    up = {f: f for f in by}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    keys = list(by)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                up[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for f, ids in by.items():
        r = root(f)
        least[r] = min(ids) if least[r] is None else min(least[r], *ids)
    return {i: least[root(f)] for f, ids in by.items() for i in ids}


def minimax(sizes, shards):
    """Smallest capacity with which a greedy walk over sizes needs no more than `shards` shards."""

    def need(cap):
        n, room = 1, cap
        for s in sizes:
            if s > room:
                n, room = n + 1, cap
            room -= s
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if need(mid) <= shards else (mid + 1, high)
    return low


KINDS = ("assign", "access", "hex")


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, p, n in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[0]) >= n]
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def crc(s):
    return zlib.crc32((s or "").encode())
