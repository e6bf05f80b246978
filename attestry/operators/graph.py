"""Identity graph: upserts, hops, rings, trust and signals.

``nodes``: id, type, trust, first_seen, last_seen and, where there are any,
attributes (a map; places have lat and lon).  ``edges``: src, dst, type, weight,
evidence, last_seen.  Edges count in both directions.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.numbers import clamp, haversine_km

#: Edge types that speak against a person (fixed values).
SUSPICIOUS = ("document_reuse", "shares_device", "shares_ip", "shares_email", "shares_phone", "biometric_match")


def upsert_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, type)."""
    return edges.groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"), F.sum("evidence").alias("evidence"), F.max("last_seen").alias("last_seen"))


def upsert_nodes(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One node for each id; endpoints that no row names become persons of
    trust 0.5."""
    if "attributes" in nodes.columns:
        # Key by key the value seen last.
        each = nodes.select("id", "last_seen", F.explode("attributes").alias("key", "value"))
        last = each.groupBy("id", "key").agg(F.max_by("value", F.struct("last_seen", "value")).alias("value"))
        maps = last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes"))
        return upsert_nodes(nodes.drop("attributes"), edges).join(maps, "id", "left")
    merged = nodes.groupBy("id").agg(F.min_by("type", "first_seen").alias("type"), F.min("trust").alias("trust"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    if edges is None:
        return merged
    ends = both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.min("last_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    stubs = ends.join(merged, "id", "left_anti").select("id", F.lit("person").alias("type"), F.lit(0.5).alias("trust"), "first_seen", "last_seen")
    return merged.unionByName(stubs)


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *rest).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), *rest))


def _cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder; one of our own only if all tasks run here."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="attestry-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def within_hops(edges: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """``start``, ``id``, ``hop`` for all nodes within so many hops of each start.

    A frontier join a hop, less what was reached before; never a whole closure.
    """
    step = both_ways(edges).select("a", "b").distinct()
    reached = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hop"))
    frontier = reached
    for hop in range(1, hops + 1):
        nxt = frontier.join(step, frontier["id"] == step["a"]).select("start", F.col("b").alias("id")).distinct()
        frontier = _cut(nxt.join(reached, ["start", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``id``, ``component`` (smallest id reachable), by label propagation with
    pointer jumping; lineage is cut each round in reliable storage."""
    step = _cut(both_ways(edges).select("a", "b").where("a <> b").distinct())
    labels = _cut(step.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")))
    for _ in range(max_rounds):
        near = step.join(labels, step["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        low = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        hop = low.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = _cut(low.join(hop, "component").select("id", F.col("far").alias("component")))
        if new.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").isEmpty():
            return new
        labels = new
    raise RuntimeError("components did not settle")


def fraud_rings(nodes: DataFrame, edges: DataFrame, min_size: int = 3, max_trust: float = 0.5) -> DataFrame:
    """Components over suspicious edges with enough nodes of low mean trust."""
    bad = edges.where(F.col("type").isin(*SUSPICIOUS))
    member = components(bad).join(nodes.select("id", "trust"), "id", "left")
    rings = member.groupBy("component").agg(F.count("*").alias("size"), F.avg(F.coalesce("trust", F.lit(0.5))).alias("mean_trust"), F.array_sort(F.collect_list("id")).alias("members"))
    return rings.where((F.col("size") >= min_size) & (F.col("mean_trust") < max_trust))


def _typed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ways with the far node: a, b, type, last_seen, kind_b, trust_b."""
    far = nodes.select(F.col("id").alias("b"), F.col("type").alias("kind_b"), F.col("trust").alias("trust_b"))
    return both_ways(edges).select("a", "b", "type", "last_seen").join(far, "b", "left")


def hub_reuse(edges: DataFrame, nodes: DataFrame, hub: str, types: tuple[str, ...] | None = None, below: float | None = None) -> DataFrame:
    """``id`` of hubs of one type and the distinct persons linked to each, over
    edges of some types, and persons with a trust ``below`` a limit, if given."""
    ways = _typed(edges, nodes).where("kind_b = 'person'")
    ways = ways.where(F.col("type").isin(*types)) if types else ways
    ways = ways.where(F.col("trust_b") < below) if below is not None else ways
    hubs = nodes.where(F.col("type") == hub).select(F.col("id").alias("a"))
    return ways.join(hubs, "a", "left_semi").groupBy(F.col("a").alias("id")).agg(F.count_distinct("b").alias("persons"))


def trust_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Trust of each node: 0.5, and from it the time between first and last seen
    (up to 0.2), suspicious edges, far ends of those with trust under 0.3,
    document reuse, and biometric matches with persons: one is in favour, more
    are against.

    A pure function of the trust given: no score depends on another new one.
    """
    kind = F.col("type")
    sums = _typed(edges, nodes).groupBy(F.col("a").alias("id")).agg(
        F.count_if(kind.isin(*SUSPICIOUS)).alias("suspicious"),
        F.count_if(kind.isin(*SUSPICIOUS) & (F.col("trust_b") < 0.3)).alias("bad"),
        F.count_if(kind == "document_reuse").alias("reuse"),
        F.count_if((kind == "biometric_match") & (F.col("kind_b") == "person")).alias("matches"),
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    days = (F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 86_400_000_000
    age = F.greatest(F.lit(0.0), F.least(F.lit(0.2), days / 365 * 0.2))
    biometric = F.when(n("matches") == 1, 0.05).when(n("matches") > 1, -F.least(F.lit(0.2), 0.1 * n("matches"))).otherwise(0.0)
    score = 0.5 + F.coalesce(age, F.lit(0.0)) - F.least(F.lit(0.3), 0.1 * n("suspicious")) - F.least(F.lit(0.4), 0.2 * n("bad")) - F.least(F.lit(0.3), 0.1 * n("reuse")) + biometric
    return nodes.join(sums, "id", "left").select("id", clamp(score).alias("score"))


def impossible_trips(nodes: DataFrame, edges: DataFrame, kmh: float = 900.0, least_km: float = 5.0) -> DataFrame:
    """``id`` of persons whose co-located places, in order of time, follow each
    other faster than ``kmh``."""
    place = nodes.where("type = 'location'").select(F.col("id").alias("b"), F.col("attributes")["lat"].try_cast("double").alias("lat"), F.col("attributes")["lon"].try_cast("double").alias("lon"))
    at = both_ways(edges).where("type = 'co-located'").select("a", "b", F.unix_micros(F.col("last_seen").cast("timestamp")).alias("us"))
    at = at.join(place.where("lat is not null and lon is not null"), "b").join(nodes.where("type = 'person'").select(F.col("id").alias("a")), "a", "left_semi")
    w = Window.partitionBy("a").orderBy("us", "b")
    before = lambda c: F.lag(c).over(w)
    steps = at.select("a", (F.col("us") - before("us")).alias("dt"), haversine_km(before("lat"), before("lon"), F.col("lat"), F.col("lon")).alias("km"))
    return steps.where((F.col("dt") > 0) & (F.col("km") >= least_km) & (F.col("km") / (F.col("dt") / 3.6e9) > kmh)).select(F.col("a").alias("id")).distinct()


def bursts(edges: DataFrame, most: int = 10, hours: float = 1.0) -> DataFrame:
    """``id`` of nodes with more than ``most`` edges last seen within some hours."""
    w = Window.partitionBy("a").orderBy("us")
    at = both_ways(edges).select("a", F.unix_micros(F.col("last_seen").cast("timestamp")).alias("us")).where("us is not null")
    return at.select("a", (F.col("us") - F.lag("us", most).over(w)).alias("span")).where(F.col("span") <= hours * 3.6e9).select(F.col("a").alias("id")).distinct()


#: Edge types that make a person known to others.
_KNOWN = ("verified_same_person", "document_reuse", "shares_device", "shares_ip", "biometric_match")


def risk_signals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``signal``, ``id``, ``severity``: the eight signals of a node's edges.

    Nodes and edges are written once.  What a node's own edges tell (all but rings,
    trips and bursts) comes from one aggregation of the edges both ways, with the
    far node's kind and trust.
    """
    nodes, edges = _cut(nodes), _cut(edges)
    person = F.col("kind_b") == "person"
    linked = lambda *types: F.count_distinct(F.when(person & F.col("type").isin(*types), F.col("b")))
    sums = _typed(edges, nodes).groupBy(F.col("a").alias("id")).agg(
        F.max(F.col("type").isin(*_KNOWN)).alias("known"),
        linked("shares_device").alias("device"),
        linked("document_reuse").alias("document"),
        linked("biometric_match").alias("biometric"),
        F.count_distinct(F.when(person & F.col("type").isin("shares_device", "shares_ip") & (F.col("trust_b") < 0.4), F.col("b"))).alias("mules"),
    )
    own = nodes.select("id", "type").join(sums, "id", "left")
    kind, n = F.col("type"), lambda c: F.coalesce(F.col(c), F.lit(0))
    signal = lambda name, severity: F.struct(F.lit(name).alias("signal"), severity.alias("severity"))
    shared = [F.when((kind == hub) & (n(hub) >= 2), signal(name, F.when(n(hub) >= critical, "critical").otherwise("high"))) for hub, name, critical in (("device", "device_reuse", 5), ("document", "document_reuse", 3), ("biometric", "biometric_duplicate", 3))]
    alone = F.when((kind == "person") & ~F.coalesce("known", F.lit(False)), signal("synthetic_identity", F.lit("medium")))
    mule = F.when((kind == "device") & (n("mules") >= 3), signal("mule_pattern", F.lit("critical")))
    out = [own.select("id", F.inline(F.array_compact(F.array(alone, *shared, mule)))).select("signal", "id", "severity")]

    def found(name: str, ids: DataFrame, severity: str) -> DataFrame:
        return ids.select(F.lit(name).alias("signal"), "id", F.lit(severity).alias("severity"))

    out.append(found("fraud_ring_member", fraud_rings(nodes, edges).select(F.explode("members").alias("id")), "critical"))
    if "attributes" in nodes.columns:
        out.append(found("impossible_travel", impossible_trips(nodes, edges), "critical"))
    out.append(found("velocity_attack", bursts(edges).join(nodes.select("id"), "id", "left_semi"), "high"))
    return reduce(DataFrame.unionByName, out)


def serialized(nodes: DataFrame, edges: DataFrame, component: DataFrame) -> DataFrame:
    """One JSON text (nodes, edges, version) for each ``component`` of ``id``s."""
    row = lambda df: F.to_json(F.struct(*sorted(df.columns)))
    n = nodes.withColumn("json", row(nodes)).join(component, "id").groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("json")), ",").alias("nodes"))
    e = edges.withColumn("json", row(edges)).join(component.withColumnRenamed("id", "src"), "src").groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("json")), ",").alias("edges"))
    text = F.concat(F.lit('{"nodes":['), "nodes", F.lit('],"edges":['), F.coalesce("edges", F.lit("")), F.lit('],"version":1}'))
    return n.join(e, "component", "left").select("component", text.alias("graph"))
