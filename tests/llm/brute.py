"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items, n=8):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM_WORD.findall(lower_ascii(text))
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w = ALNUM_WORD.findall(lower_ascii(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[k]
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, len(found) >= 2))
    return out


def fingerprint(text):
    w = SPACE_WORD.findall(lower_ascii(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(ids)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = find(a), find(b)
            if x != y and linked(a, b):
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def repeats(docs, size):
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, b in raw:
        seen.update(b[p : p + size] for p in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = [True] * size
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


def line_stats(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def same_line(a, b, limits=((12, 1), (24, 2), (200, 3))):
    most = max((k for least, k in limits if min(len(a), len(b)) >= least), default=0)
    if abs(len(a) - len(b)) > most:
        return False
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return max(len(a), len(b)) <= most or (min(len(a), len(b)) < 200 and edit_distance(a, b) <= most)


def line_dedup(docs):
    """(id, lines, exact, near, kept text) of each document; texts of one id must differ."""
    norm = lambda x: " ".join(x.lower().split())
    places = defaultdict(list)
    for at in sorted({(i is not None, i or 0, t or "") for i, t in docs}):
        for k, line in enumerate(at[2].split("\n")):
            if norm(line):
                places[norm(line)].append((at[:2], at[2], k))
    lines = sorted(places)
    by = defaultdict(list)
    for i, c in components(range(len(lines)), lambda a, b: same_line(lines[a], lines[b])).items():
        by[c].append(lines[i])
    gone = {}
    for group in by.values():
        speaker = min(group, key=lambda x: places[x][0])
        for x in group:
            for p in places[x]:
                if p != places[speaker][0]:
                    gone[p] = x == speaker
    out = []
    for i, t in docs:
        own = (i is not None, i or 0)
        drop = {k: gone[own, t or "", k] for k in range(len((t or "").split("\n"))) if (own, t or "", k) in gone}
        kept = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in drop)
        out.append((i, len((t or "").split("\n")), sum(drop.values()), len(drop) - sum(drop.values()), kept))
    return out


def shingles(text, n=5):
    w = SPACE_WORD.findall(lower_ascii(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
