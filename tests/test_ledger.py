"""Chains, Merkle proofs and blocks against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import canonical
from attestry.operators import chains, ledger


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha(last[i] + last[min(i + 1, len(last) - 1)]) for i in range(0, len(last), 2)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        out.append(("left", level[i - 1]) if i % 2 else ("right", level[min(i + 1, len(level) - 1)]))
        i //= 2
    return out


@pytest.mark.parametrize("fan", [1, 2, 3])
def test_proofs_of_all_leaves(spark, fan):
    rng = random.Random(fan)
    sizes = {"a": 1, "b": 2, "c": 5, "d": 16, "e": 37, None: 3}
    rows = [(k, j, f"{k} {j}") for k, n in sizes.items() for j in range(n)]
    rng.shuffle(rows)
    leaves = spark.createDataFrame(rows, "k string, j int, v string").repartition(3)
    found, trees = ledger.tree(leaves, ["k"], ["j"], F.col("v"), fan=fan)
    want = {k: levels([sha(f"{k} {j}") for j in range(n)]) for k, n in sizes.items()}
    assert {r.k: r.root for r in trees.roots().collect()} == {k: t[-1][0] for k, t in want.items()}
    got = trees.proofs(found).withColumn("to", ledger.climbed(F.col("h"), F.col("proof"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.i == r.j and [tuple(e) for e in r.proof] == path(want[r.k], r.i)
        assert r.to == want[r.k][-1][0]
    # A changed leaf leads elsewhere, and no other proof does.
    wrong = trees.proofs(found).where("k = 'e'").withColumn("to", ledger.climbed(F.when(F.col("i") == 20, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.col("h")), F.col("proof"))).collect()
    assert [r.i for r in wrong if r.to != want["e"][-1][0]] == [20]


def test_numbers_of_one_large_tree(spark):
    leaves = spark.range(3000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 3000).alias("j"))
    got = ledger.numbered(leaves, ["k"], ["j"])
    assert got.where("i <> j").count() == 0 and got.count() == 3000
    parts = got.rdd.getNumPartitions()
    assert parts >= 1
    assert ledger.numbered(leaves.where("false"), ["k"], ["j"]).count() == 0


def test_gdpr_chain_loses_nested_keys(spark):
    """Hashes over a list of names: of nested details only keys of those names stay."""
    events = [("u1", i, {"type": t, "user_id": "u1", "timestamp": f"2024-01-0{i + 1}", "details": {"k": i, "type": "inner", "list": [1]}, "actor": "system"}) for i, t in enumerate(["consent", "export", "erasure"])]
    names = sorted(["type", "user_id", "timestamp", "details", "actor"])
    df = spark.createDataFrame([(u, i, json.dumps(e)) for u, i, e in events], "u string, i int, e string")
    chain = ledger.linked(df, "u", ["i"], F.lit(""), canonical.rewritten(keys=names)(F.col("e")), "0" * 64)
    last = "0" * 64
    for r, (_, _, e) in zip(chain.orderBy("i").collect(), events, strict=True):
        text = json.dumps({n: {"type": "inner"} if n == "details" else e[n] for n in names}, separators=(",", ":"))
        assert r.prev_hash == last
        last = sha(last + text)
        assert r.hash == last
    assert ledger.verified(chain, "u", "0" * 64).first() == ("u1", 3, last, None)
    broken = chain.withColumn("tail", F.when(F.col("idx") == 1, "x").otherwise(F.col("tail")))
    assert ledger.verified(broken, "u", "0" * 64).first().first_broken == 1
    gone = chain.where("idx <> 1")
    assert ledger.verified(gone, "u", "0" * 64).first().first_broken == 2


def test_risk_chain(spark):
    """Sixteen digits over sorted keys with spaces, the previous hash among them, and an HMAC over the whole entry."""
    import hmac

    rows = [("s", i, json.dumps({"score": s, "decision": d, "reason_codes": c, "session_id": "s", "timestamp": 1000.5 + i, "details_hash": sha(json.dumps({"i": i}))[:16], "prev_hash": "@", "hash": "#"})) for i, (s, d, c) in enumerate([(0.5, "approve", []), (1.0, "reject é", ["A", "B"])])]
    df = spark.createDataFrame(rows, "k string, i int, e string").withColumn("e", canonical.rewritten(spaced=True)("e"))
    bare = F.replace("e", F.lit('"hash": "#", '), F.lit(""))
    chain = ledger.linked(df, "k", ["i"], F.substring_index(bare, "@", 1), F.substring_index(bare, "@", -1), "genesis", 16)
    sealed = chain.withColumn("hmac", F.substring(chains.signed("secret")(F.replace(F.replace("e", F.lit("@"), "prev_hash"), F.lit("#"), "hash")), 1, 16))
    before = "genesis"
    for r, (_, _, e) in zip(sealed.orderBy("i").collect(), rows, strict=True):
        entry = json.loads(e) | {"prev_hash": before}
        entry.pop("hash")
        entry["hash"] = sha(json.dumps(entry, sort_keys=True))[:16]
        assert (r.prev_hash, r.hash) == (before, entry["hash"])
        assert r.hmac == hmac.new(b"secret", json.dumps(entry, sort_keys=True).encode(), hashlib.sha256).hexdigest()[:16]
        before = r.hash
    assert ledger.verified(chain, "k", "genesis", 16).first().first_broken is None


def test_blocks(spark):
    rows = [("a", i, f"t{i}", f"tx {i}") for i in range(11)] + [("b", 0, "t", "only")]
    df = spark.createDataFrame(rows, "k string, i int, t string, v string").repartition(3)
    chain, entries = ledger.blocks(df.withColumnRenamed("i", "n_"), "k", ["n_"], F.col("t"), F.col("v"), F.concat(F.lit("v"), F.col("block").cast("string")), 4)
    want = {}
    for k, own in (("a", [r[3] for r in rows if r[0] == "a"]), ("b", ["only"])):
        stamps = [r[2] for r in rows if r[0] == k]
        last, out = "0" * 64, []
        for b in range(-(-len(own) // 4) + 1):
            part = own[4 * (b - 1) : 4 * b] if b else []
            root = levels([sha(x) for x in part])[-1][0] if part else sha("genesis")
            t = stamps[min(4 * b, len(own)) - 1] if b else stamps[0]
            last_ = sha(json.dumps({"index": b, "timestamp": t, "previousHash": last, "merkleRoot": root, "nonce": 0, "validator": f"v{b}" if b else "genesis"}, separators=(",", ":")))
            out.append((b, root, last, last_))
            last = last_
        want[k] = out
    for k in want:
        assert [(r.block, r.root, r.prev_hash, r.hash) for r in chain.where(F.col("k") == k).orderBy("block").collect()] == want[k]
    fine = {r.k: (r.blocks, r.head, r.first_broken, r.first_changed) for r in ledger.blocks_checked(chain, entries, "k").collect()}
    assert fine == {k: (len(v), v[-1][3], None, None) for k, v in want.items()}
    other = entries.withColumn("h", F.when((F.col("k") == "a") & (F.col("block") == 2) & (F.col("i") == 1), F.lit(sha("x"))).otherwise(F.col("h")))
    assert {r.k: r.first_changed for r in ledger.blocks_checked(chain, other, "k").collect()} == {"a": 2, "b": None}
    cut_off = chain.where("not (k = 'a' and block = 1)")
    assert {r.k: r.first_broken for r in ledger.blocks_checked(cut_off, entries, "k").collect()}["a"] == 2
