"""The conversation trie against a plain Python trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from attestry.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, conv string, depth int, size int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 7) for r in rows], SCHEMA).repartition(3)


def paths(rows):
    """conv_id -> turns in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            out[conv].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    return {c: [t for _, t in sorted(v)] for c, v in out.items()}


def regroup(own, group, spread):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % spread
        base = c - int(abs(c) % group) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(built):
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) > len(p) for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in own if len(built[c]) == len(path))
        out.append((own[0], len(path), members[path[:-1]][0] if path else None, len(own), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    given = []
    for c in [*range(-12, 30), 2**40, 2**40 + 1]:
        for turn in range(rng.randrange(0, 12)):
            given.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "ü", "long text", ""]) * rng.choice([1, 1, 3]) if rng.random() < 0.9 else None))
    got = rows(prefix_trie.nodes(prefix_trie.occurrences(prefix_trie.regrouped(prefix_trie.turns(frame(spark, given)), 5, 9), ("base", "conv"))))
    assert got == brute(regroup(paths(given), 5, 9))
    assert rows(prefix_trie.trie(frame(spark, given))) == brute(paths(given))


def test_turnless_and_absent_bases(spark):
    """A conversation may keep no turn at all; it then ends at the root."""
    short = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2]
    given = [(c, t, "user", "x") for c in short[:4] for t in range(2)]
    got = rows(prefix_trie.nodes(prefix_trie.occurrences(prefix_trie.regrouped(prefix_trie.turns(frame(spark, given)), 5, 9), ("base", "conv"))))
    assert got == brute(regroup(paths(given), 5, 9)) and len(got) == 1


def test_odd_rows(spark):
    """Null ids go; null turns come first; ties go by content; repeated rows are turns."""
    given = [(None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, "user", "first"), (3, 0, None, None), (3, 1, "a", "bc"), (4, 0, "", ""), (4, 1, "ab", "c"), (5, 0, "user", "é" * 200_000)]
    assert rows(prefix_trie.trie(frame(spark, given))) == brute(paths(given))
    assert rows(prefix_trie.trie(frame(spark, []))) == []


def test_one_hot_start(spark):
    """Most conversations start alike, a third are equal; parents come by broadcast and by join."""
    given = [(c, 0, "user", "hot") for c in range(900)] + [(c, 1, "assistant", f"r{c % 7}" if c % 3 else "same") for c in range(900)] + [(c, 2, "user", str(c)) for c in range(0, 900, 2)]
    got = rows(prefix_trie.trie(frame(spark, given)))
    assert got == brute(paths(given))


def test_ends_in_pieces(spark):
    """A group's ids are hashed over the borders of pieces and ranges."""
    ids = spark.createDataFrame([(a, 5 * a, c - 300) for a in range(3) for c in range(700 if a else 1)], "a long, b long, conv long").repartition(3)
    want = sorted((a, 5 * a, hashlib.sha256(",".join(str(c - 300) for c in range(700 if a else 1)).encode()).hexdigest()) for a in range(3))
    assert rows(prefix_trie.member_hashes(ids, piece=400)) == want
