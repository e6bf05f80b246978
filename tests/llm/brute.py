"""Plain Python versions of the operators, for comparison on small inputs."""

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(docs, window):
    """doc_id -> (n_words, n_removed, sha of kept words)."""
    words = [(i, SPACED.findall(t or "")) for i, t in docs]
    seen = Counter(tuple(w[j : j + window]) for _, w in words for j in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), sha(" ".join(kept))))
    return sorted(out)


def shingles(text, k):
    w = SPACED.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1)))


def jaccard_groups(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def hits(docs, items, window=10):
    """doc_id -> (n_words, n_hit, sorted item ids)."""
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    tests = []
    for item, t in items:
        w = words(t)
        if w:
            size = min(window, len(w))
            tests.append((str(item), {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}, size))
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for item, wins, size in tests:
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in wins:
                    hit[j : j + size] = [True] * size
                    found.add(item)
        out.append((i, len(w), sum(hit), sorted(found)))
    return sorted(out)


def phrases(text):
    w = ALNUM.findall((text or "").translate(LOWER))
    out = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), sorted(out)
