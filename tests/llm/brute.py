"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def jaccard(rows, n, percent):
    """rows (id, text) with distinct ids -> id: (set size, component, links)."""
    sets = []
    for _, text in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up, links = {i: i for i, _ in rows}, Counter()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(rows[a][0]), top(rows[b][0])))
                up[y] = x
                links.update((rows[a][0], rows[b][0]))
    return {i: (len(s), top(i), links[i]) for (i, _), s in zip(rows, sets, strict=True)}


def contamination(rows, items, size=13):
    windows = defaultdict(set)
    for item, text in items:
        w = TERMS.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add("" if item is None else str(item))
    out = []
    for i, text in rows:
        w = TERMS.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for m in {len(k) for k in windows}:
            for at in range(len(w) - m + 1):
                if tuple(w[at : at + m]) in windows:
                    hit |= set(range(at, at + m))
                    found |= windows[tuple(w[at : at + m])]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def earlier_windows(rows, size=20):
    """rows (id, text); a row is removed from where its window starts at a smaller (id, start)."""
    first = {}
    low = [(float("-inf") if i is None else i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in low:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for (i, _), (j, w) in zip(rows, low, strict=True):
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (j, k):
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def lines(rows):
    keyed = [(i, [(x, x.strip(" \t\n\x0b\f\r").translate(LOWER)) for x in (t or "").split("\n")]) for i, t in rows]
    docs, keeper = Counter(), {}
    for i, ls in keyed:
        for key in {k for _, k in ls if len(k) >= 20}:
            docs[key] += 1
            old = keeper.get(key)
            keeper[key] = i if key not in keeper or old is None or (i is not None and i > old) else old
    out = []
    for i, ls in keyed:
        kept = [x for x, k in ls if docs[k] < 3 or keeper[k] == i]
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def repeated_bytes(rows, size=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + size] for b in data for k in range(len(b) - size + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out
