"""Queries over chains, Merkle proofs and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import canonical
from attestry.operators import chains, ledger
from attestry.sources.tables import read

#: Names that a consent event's hash covers; nested objects lose all others.
GDPR_NAMES = ("actor", "details", "timestamp", "type", "user_id")
ZEROS = "0" * 64


def _json(value, kind, keys=None):
    return canonical.canonical(value, kind, keys)


def _stamped(events):
    return F.unix_micros(F.col("ts").cast("timestamp")).cast("string")


def gdpr_chain(spark, sf_dir):
    """A chain of each user's events; their details keep ``type`` only."""
    e = read(spark, sf_dir, "events")
    details = F.struct(F.col("props").alias("k"), F.col("event_type").alias("type"), F.array("event_id").alias("ids"))
    rows = e.select("user_id", "ts", "event_id", F.struct(F.lit("system").alias("actor"), details.alias("details"), _stamped(e).alias("timestamp"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("user_id")).alias("said"))
    rows = rows.select("user_id", "ts", "event_id", _json(F.col("said"), rows.schema["said"].dataType, GDPR_NAMES).alias("said"))
    return ledger.verified(ledger.linked(rows, "user_id", ["ts", "event_id"], F.lit(""), F.col("said"), ZEROS), "user_id", ZEROS)


def event_chain(spark, sf_dir):
    """A chain of each user's events with their properties, parsed and written anew."""
    e = read(spark, sf_dir, "events")
    payload = F.concat(F.lit('{"value":'), canonical.number(F.col("value")), F.lit(',"props":'), canonical.rewritten()("props"), F.lit("}"))
    said = F.concat(F.lit('{"event_type":'), canonical.text(F.col("event_type")), F.lit(',"timestamp":'), canonical.text(_stamped(e)), F.lit(',"payload":'), payload, F.lit("}"))
    rows = e.select("user_id", "ts", "event_id", said.alias("said"))
    return ledger.verified(ledger.linked(rows, "user_id", ["ts", "event_id"], F.lit(""), F.col("said"), ZEROS), "user_id", ZEROS)


def risk_chain(spark, sf_dir):
    """A chain of each customer's decisions: sixteen digits, sorted keys with spaces, an HMAC over the last entry."""
    o = read(spark, sf_dir, "orders")
    entry = F.struct(
        F.when(F.col("o_orderstatus") == "F", "reject").otherwise("approve").alias("decision"),
        F.substring(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256), 1, 16).alias("details_hash"),
        F.lit("#").alias("hash"),
        F.lit("@").alias("prev_hash"),
        F.array("o_orderpriority").alias("reason_codes"),
        F.col("o_orderkey").alias("score"),
        F.col("o_custkey").cast("string").alias("session_id"),
    )
    said = canonical.rewritten(spaced=True)(F.to_json(entry))
    rows = o.select("o_custkey", "o_orderdate", "o_orderkey", said.alias("said"))
    bare = F.replace("said", F.lit('"hash": "#", '), F.lit(""))
    chain = ledger.linked(rows, "o_custkey", ["o_orderdate", "o_orderkey"], F.substring_index(bare, "@", 1), F.substring_index(bare, "@", -1), "genesis", 16)
    return ledger.verified(chain, "o_custkey", "genesis", 16)


def fairness_trail(spark, sf_dir):
    """A chain of all decisions of each priority: the previous hash is the last part of the entry."""
    o = read(spark, sf_dir, "orders")
    head = F.concat(F.lit('{"decision_id":"'), F.col("o_orderkey").cast("string"), F.lit('","timestamp":"2024-01-01T00:00:00.000Z","computed_metrics":{"custkey":'), F.col("o_custkey").cast("string"), F.lit('},"previous_hash":"'))
    rows = o.select(F.col("o_orderpriority").alias("model"), "o_orderdate", "o_orderkey", head.alias("said"))
    chain = ledger.linked(rows, "model", ["o_orderdate", "o_orderkey"], F.col("said"), F.lit('"}'), ZEROS)
    return ledger.verified(chain, "model", ZEROS).select("model", (F.col("entries") - 1).alias("last_idx"), "head")


def merkle_proofs(spark, sf_dir):
    """The proof of every order in the tree of its priority, and where it leads."""
    o = read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    leaves, trees = ledger.tree(o, ["o_orderpriority"], ["o_orderkey"], F.col("o_orderkey"))
    found = trees.proofs(leaves)
    path = F.array_join(F.transform("proof", lambda e: F.concat(e["position"], F.lit(":"), e["hash"])), ",")
    return found.select("o_orderpriority", "o_orderkey", F.col("i").alias("place"), F.size("proof").cast("long").alias("depth"), F.md5(path.cast("binary")).alias("proof"), ledger.climbed(F.col("h"), F.col("proof")).alias("root"))


def ledger_blocks(spark, sf_dir):
    """Blocks of 100 orders of each priority, checked: links and roots."""
    o = read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate")
    chain, entries = ledger.blocks(o, "o_orderpriority", ["o_orderkey"], F.col("o_orderdate").cast("date").cast("string"), F.col("o_orderkey"), F.concat(F.lit("v"), F.col("block").cast("string")), 100)
    return ledger.blocks_checked(chain, entries, "o_orderpriority")


def _fold(group: str, key: str, order: str, table: str, text: str, genesis: str, size: int = 64) -> str:
    """A chain as a fold over its texts: h is the hash so far, p the entry's parts."""
    return f"select {group} {key}, count(*) entries, list_reduce(list_prepend({{'a': '{genesis}', 'b': ''}}, list({{'a': a, 'b': b}} order by {order})), lambda h, p: {{'a': substr(sha256({text}), 1, {size}), 'b': ''}}).a head, null::bigint first_broken from {table} group by 1"


_LEVELS = """l as (select o_orderpriority k, 0 l, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 i, sha256(o_orderkey::varchar) h from orders
  union all select k, l + 1, i // 2, sha256(h || coalesce(n, h)) from (select *, lead(h) over (partition by k order by i) n, count(*) over (partition by k) c from l) where c > 1 and i % 2 = 0)"""
_BLOCK_LEVELS = """e as (select o_orderpriority k, o_orderkey, o_orderdate::date::varchar t, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 j from orders),
l as (select k, j // 100 + 1 b, 0 l, j % 100 i, sha256(o_orderkey::varchar) h from e
  union all select k, b, l + 1, i // 2, sha256(h || coalesce(n, h)) from (select *, lead(h) over (partition by k, b order by i) n, count(*) over (partition by k, b) c from l) where c > 1 and i % 2 = 0),
r as (select k, b, arg_max(h, l) root from l group by 1, 2), t as (select k, j // 100 + 1 b, arg_max(t, j) t, arg_min(t, j) f from e group by 1, 2),
m as (select k, b, t, root, 'v' || b v from r join t using (k, b) union all select k, 0, f, sha256('genesis'), 'genesis' from t where b = 1),
q as (select k, b, '{"index":' || b || ',"timestamp":"' || t || '","previousHash":"' a, '","merkleRoot":"' || root || '","nonce":0,"validator":"' || v || '"}' z from m)"""
QUERIES = {
    "gdpr_chain": (
        gdpr_chain,
        """with e as (select *, '' a, '{"actor":"system","details":{"type":"' || event_type || '"},"timestamp":"' || epoch_us(ts) || '","type":"' || event_type || '","user_id":"' || user_id || '"}' b from events) """
        + _fold("user_id", "user_id", "ts, event_id", "e", "h.a || p.b", ZEROS),
    ),
    "event_chain": (
        event_chain,
        """with e as (select *, '' a, '{"event_type":"' || event_type || '","timestamp":"' || epoch_us(ts) || '","payload":{"value":' || regexp_replace(value::varchar, '\\.0$', '') || ',"props":{"k":' || json_extract_string(props, '$.k') || '}}}' b from events) """
        + _fold("user_id", "user_id", "ts, event_id", "e", "h.a || p.b", ZEROS),
    ),
    "risk_chain": (
        risk_chain,
        """with e as (select *, '{"decision": "' || case when o_orderstatus = 'F' then 'reject' else 'approve' end || '", "details_hash": "' || substr(sha256(o_orderkey::varchar), 1, 16) || '", "prev_hash": "' a, '", "reason_codes": ["' || o_orderpriority || '"], "score": ' || o_orderkey || ', "session_id": "' || o_custkey || '"}' b from orders) """
        + _fold("o_custkey", "o_custkey", "o_orderdate, o_orderkey", "e", "p.a || h.a || p.b", "genesis", 16),
    ),
    "fairness_trail": (
        fairness_trail,
        """with e as (select *, '{"decision_id":"' || o_orderkey || '","timestamp":"2024-01-01T00:00:00.000Z","computed_metrics":{"custkey":' || o_custkey || '},"previous_hash":"' a, '"}' b from orders), f as ("""
        + _fold("o_orderpriority", "model", "o_orderdate, o_orderkey", "e", "p.a || h.a || p.b", ZEROS)
        + ") select model, entries - 1 last_idx, head from f",
    ),
    "merkle_proofs": (
        merkle_proofs,
        f"""with recursive {_LEVELS},
        t as (select k, max(l) d, arg_max(h, l) root from l group by 1),
        a as (select k, o_orderkey, row_number() over (partition by k order by o_orderkey) - 1 i from (select o_orderpriority k, o_orderkey from orders)),
        u as (select a.*, d, root, unnest(range(d)) s from a join t using (k)),
        v as (select u.*, i >> s pos from u),
        w as (select v.*, case when pos % 2 = 1 then 'left:' else 'right:' end || coalesce(n.h, o.h) e from v left join l n on n.k = v.k and n.l = s and n.i = xor(pos, 1) left join l o on o.k = v.k and o.l = s and o.i = pos)
        select k o_orderpriority, o_orderkey, i place, d depth, md5(string_agg(e, ',' order by s)) proof, any_value(root) root from w group by k, o_orderkey, i, d""",
    ),
    "ledger_blocks": (
        ledger_blocks,
        f"""with recursive {_BLOCK_LEVELS}
        select k o_orderpriority, count(*) blocks, list_reduce(list_prepend({{'a': '{ZEROS}', 'z': ''}}, list({{'a': a, 'z': z}} order by b)), lambda h, p: {{'a': sha256(p.a || h.a || p.z), 'z': ''}}).a head, null::bigint first_broken, null::bigint first_changed from q group by 1""",
    ),
}
