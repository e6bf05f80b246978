"""Records of verifications: IDs, graphs, logs, quality, names, reasons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.operators import records, risk
from attestry.plans.risk import _cases
from attestry.sources.tables import read

_MODALITIES = (("face", 7), ("voice", 5), ("behavioral", 11), ("document", 9), ("device", 4))
_DIMENSIONS = {name: m for m, name in enumerate(records.FACE_QUALITY, 3)}
_NAMES = ("mohamed", "ahmed", "fatima", "mariam", "youssef", "khaled", "nadia", "salma", "omar", "hassan", "laila", "tarek")


def egyptian_records(spark, sf_dir):
    """Customers' IDs: all centuries, months and days, right and wrong, with dashes."""
    k = F.col("c_custkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    raw = F.concat((k % 3 + 2).cast("string"), pad(k % 100, 2), F.lit("-"), pad(k % 14, 2), pad(k % 33, 2), F.lit("-"), pad(k * 7919 % 1000000, 6), (k % 10).cast("string"))
    raw = F.when(k % 29 == 0, F.substring(raw, 2, 20)).otherwise(raw)
    return read(spark, sf_dir, "customer").select("c_custkey", records.egyptian_record(raw).alias("r")).select("c_custkey", "r.*")


def top_contributor(spark, sf_dir):
    k = F.col("o_orderkey")
    items = [F.struct(F.lit(n).alias("modality"), (k % m / m).alias("score"), (k % (m + 2) / (m + 2)).alias("weight")) for n, m in _MODALITIES]
    top = read(spark, sf_dir, "orders").select("o_orderkey", records.top_contributor(F.array(*items)).alias("t"))
    return top.select("o_orderkey", F.col("t.modality").alias("modality"), F.round("t.score", 6).alias("score"))


def generator_diversity(spark, sf_dir):
    part = lambda i: F.split("c_name", "#")[i]
    return records.diversity(read(spark, sf_dir, "customer"), names=F.col("c_name"), first_names=part(0), family_names=part(1), governorates=F.col("c_nationkey"))


def graph_reconstruction(spark, sf_dir):
    """Orders as verifications of their customers, some without name or ID."""
    k = F.col("o_orderkey")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.concat(F.lit("N-"), F.col("c_custkey") + 10000).alias("c_id"))
    at = F.col("o_orderdate").cast("date")
    rows = read(spark, sf_dir, "orders").join(c, "o_custkey").select(
        k.alias("id"), F.col("o_custkey").alias("user_id"), F.when(k % 5 > 0, F.col("c_name")).alias("name_en"), F.when(k % 3 > 0, F.lit("")).otherwise("x").alias("name_ar"), F.when(k % 2 > 0, F.col("c_id")).alias("national_id"),
        F.col("o_orderpriority").alias("doc_type"), F.concat(F.lit("D"), k).alias("document_no"), F.lit("EG").alias("country"), at.alias("created_at"), F.date_add(at, 3).alias("updated_at"),
    )
    nodes, edges = records.graph_of(rows)
    seen = nodes.select(F.lit("node").alias("kind"), "id", F.lit("").alias("other"), "type", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))
    links = edges.select(F.lit("edge").alias("kind"), F.col("src").alias("id"), F.col("dst").alias("other"), "type", F.lit(None).cast("string").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))
    return seen.unionByName(links)


def source_provenance(spark, sf_dir):
    """Events as changes of their users' states: automatic and noted entries."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = read(spark, sf_dir, "events").withColumn("before", before)
    parts = [F.col("user_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("before"), F.col("event_type")]
    note = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("n"), F.col("event_id")))
    return e.select("event_id", records.source_entry(*parts).alias("automatic"), records.source_entry(*parts, note).alias("noted"))


def face_quality(spark, sf_dir):
    k = F.col("o_orderkey")
    given = {n: F.when(k % 31 > m % 3, k % m / (m - 1)) for n, m in _DIMENSIONS.items()}
    return read(spark, sf_dir, "orders").select("o_orderkey", records.face_quality(**given).alias("q")).select("o_orderkey", "q.*")


def corrected_names(spark, sf_dir):
    """Two dictionary names a customer; a letter of the first is misread for most,
    two letters of the second for some."""
    k = F.col("c_custkey")
    pick = lambda n: F.element_at(F.array(*map(F.lit, _NAMES)), (n % len(_NAMES) + 1).cast("int"))
    one, two = pick(k), pick(k * 7 + 3)
    one = F.when(k % 4 > 0, F.overlay(one, F.lit("x"), (k % 5 + 1).cast("int"))).otherwise(one)
    two = F.when(k % 6 == 0, F.concat(F.lit("zz"), two)).otherwise(two)
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("  ", one, two).alias("name"))
    return records.corrected_names(rows, "c_custkey", "name", spark.createDataFrame([(n,) for n in _NAMES], "entry string"), "entry")


def written_reasons(spark, sf_dir):
    s = risk.signals()
    names = ("document_authenticity", "ocr_confidence", "cross_field_consistency", "face_match_confidence", "liveness_confidence", "device_signals", "ai_consensus_confidence")
    facts = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[s[n] for n in names]))
    rows = _cases(spark, sf_dir).select("o_orderkey", facts.alias("signals"), risk.evaluate().alias("r"))
    return rows.select("o_orderkey", records.reasons(F.col("signals"), F.col("r")).alias("reasons"))


_PAD = lambda e, n: f"lpad(({e})::varchar, {n}, '0')"
_NAME_LIST = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
_Q = {n: f"case when k % 31 > {m % 3} then k % {m} / {m - 1}.0::double else 0 end" for n, m in _DIMENSIONS.items()}
QUERIES = {
    "egyptian_records": (
        egyptian_records,
        f"""with r as (select c_custkey k, (2 + c_custkey % 3)::varchar || {_PAD('c_custkey % 100', 2)} || {_PAD('c_custkey % 14', 2)} || {_PAD('c_custkey % 33', 2)} || {_PAD('c_custkey * 7919 % 1000000', 6)} || (c_custkey % 10)::varchar s from customer),
        d as (select k, s, k % 3 < 2 and k % 14 between 1 and 12 and k % 33 between 1 and 31 known, k % 29 > 0 whole, list_sum(list_transform(range(1, 14), lambda i: s[i]::bigint * [2, 7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2][i])) total from r),
        p as (select *, (11 - total % 11) % 10 = k % 10 good, 1900 + k % 3 * 100 + k % 100 y from d)
        select k c_custkey, case when whole and known then y end as year, case when whole and known then k % 14 end as month, case when whole and known then k % 33 end as day, case when whole and known then y || '-' || s[4:5] || '-' || s[6:7] end birth_date,
        case when whole and known then case when s[13]::int % 2 = 1 then 'Male' else 'Female' end end gender, case when whole and known then s[8:9]::bigint end governorate, case when whole and known then good end checksum_valid, case when whole then known and good end is_valid from p""",
    ),
    "top_contributor": (
        top_contributor,
        f"""with m as (select o_orderkey, i, n, o_orderkey % m / m::double s, o_orderkey % (m + 2) / (m + 2)::double w from orders, (values {', '.join(f"({i}, '{n}', {m})" for i, (n, m) in enumerate(_MODALITIES))}) t(i, n, m))
        select o_orderkey, n modality, round(s, 6) score from m qualify row_number() over (partition by o_orderkey order by w * s desc, i) = 1""",
    ),
    "generator_diversity": (generator_diversity, "select count(distinct c_name) as names, count(distinct split_part(c_name, '#', 1)) first_names, count(distinct split_part(c_name, '#', 2)) family_names, count(distinct c_nationkey) governorates from customer"),
    "graph_reconstruction": (
        graph_reconstruction,
        """with v as (select o_orderkey k, o_orderdate::date d, 'person:' || case when o_orderkey % 5 > 0 then c_name when o_orderkey % 3 = 0 then 'x' else 'unknown' end || '|' || case when o_orderkey % 2 > 0 then 'N-' || (c_custkey + 10000) else c_custkey::varchar end p from orders join customer on o_custkey = c_custkey)
        select 'node' kind, p id, '' other, 'person' as type, strftime(min(d), '%Y-%m-%d') first_seen, strftime(min(d) + 3, '%Y-%m-%d') last_seen from v group by p
        union all select 'node', 'doc:' || k, '', 'document', strftime(d, '%Y-%m-%d'), strftime(d + 3, '%Y-%m-%d') from v union all select 'edge', 'doc:' || k, p, 'verified_same_person', null, strftime(d + 3, '%Y-%m-%d') from v""",
    ),
    "source_provenance": (
        source_provenance,
        """with e as (select *, lag(event_type) over (partition by user_id order by ts, event_id) b from events), p as (select event_id, user_id || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || coalesce(b, '') || '|' || event_type s from e)
        select event_id, sha256(s) automatic, sha256(s || '|' || case when event_id % 3 > 0 then 'n' || event_id else '' end) noted from p""",
    ),
    "face_quality": (
        face_quality,
        f"""with q as (select k, least(1.0::double, greatest(0.0::double, {' + '.join(f'{e} * {w}::double' for e, w in zip(_Q.values(), (.08, .08, .18, .15, .08, .12, .10, .05, .05, .03, .03, .03, .02), strict=True))})) c,
        {' + '.join(f'{e} * {w}::double' for e, w in zip(_Q.values(), (.15, .15, .30, .25, .15), strict=False))} o from (select o_orderkey k from orders))
        select k o_orderkey, floor(c * 1000.0::double + 0.5) / 1000.0::double composite, floor(o * 1000.0::double + 0.5) / 1000.0::double overall, c >= 0.5 as pass from q""",
    ),
    "corrected_names": (
        corrected_names,
        f"""with d as (select unnest({_NAME_LIST}) e), g as (select c_custkey k, {_NAME_LIST}[c_custkey % 12 + 1] a, {_NAME_LIST}[(c_custkey * 7 + 3) % 12 + 1] b from customer),
        t as (select k, case when k % 4 > 0 then left(a, k % 5) || 'x' || substr(a, k % 5 + 2) else a end a, case when k % 6 = 0 then 'zz' || b else b end b from g),
        w as (select a w from t union select b from t), n as (select w, arg_min(e, (levenshtein(w, e), e)) e from w, d where levenshtein(w, e) <= 1 group by w)
        select k c_custkey, coalesce(x.e, a) || ' ' || coalesce(y.e, b) corrected, true changed from t left join n x on x.w = a left join n y on y.w = b""",
    ),
    "written_reasons": (written_reasons, None),
}
