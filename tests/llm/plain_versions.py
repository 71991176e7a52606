"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

SPACE, WORD = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def luhn(digits):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    """``(order, kind, start, end)`` in order of kind and start."""
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 13 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15))
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern, ok in rules for m in re.finditer(pattern, text or "")
            if ok(m[0], re.sub("[^0-9]", "", m[0]))]


def shingle_set(text, n=5):
    words = WORD.findall((text or "").translate(UPPER))
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near(rows):
    """``(lineage, n_shingles, component_id, kept)`` for each ``(lineage, genes)``."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            group[top(a)] = top(b)
    names = defaultdict(list)
    for i, (lineage, _) in enumerate(rows):
        names[top(i)].append(lineage)
    out = []
    for i, (lineage, _) in enumerate(rows):
        known = [x for x in names[top(i)] if x is not None]
        component = min(known) if known else None
        out.append((lineage, len(sets[i]), component, lineage == component))
    return out


def cut(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (lineage, _), b in zip(rows, texts, strict=True):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((lineage, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def shared(rows, items, window=10):
    listed = [(str(k) if k is not None else None, ALNUM.findall((t or "").translate(UPPER))) for k, t in items]
    out = []
    for lineage, text in rows:
        words, hit, found = ALNUM.findall((text or "").translate(UPPER)), set(), set()
        for name, item in listed:
            n = min(len(item), window)
            windows = {tuple(item[i:i + n]) for i in range(len(item) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if n and tuple(words[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(name)
        names = sorted(x for x in found if x is not None)
        out.append((lineage, len(words), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def equal(rows):
    groups = defaultdict(list)
    for lineage, text in rows:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), lineage is not None, lineage))
    out = []
    for lineage, text in rows:
        bare = SPACE.sub("", text or "")
        best = min(groups[bare], key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))
        out.append((lineage, best[2], len(groups[bare]), best[2] == lineage and -best[0] == len(text or ""), sha(bare)))
    return out
