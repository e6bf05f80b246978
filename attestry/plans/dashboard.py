"""Dashboards, latency, evaluation and coverage rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions.numbers import half_up
from attestry.operators import catalog, evaluate, rules
from attestry.plans.common import SIGNALS_SQL, signals
from attestry.sources.tables import MISSING, find_many, read, where_equal, with_children


def summary(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("as_of"))
    recent = F.col("ts") > F.col("as_of") - F.expr("interval 7 days")
    return events.crossJoin(F.broadcast(last)).groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(recent).alias("recent"), F.round(F.avg(F.coalesce("value", F.lit(0.0))), 4).alias("avg_value"))


def hourly(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("as_of"))
    day = events.crossJoin(F.broadcast(last)).where(F.col("ts") > F.col("as_of") - F.expr("interval 24 hours"))
    return day.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))


def shares(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("event_type", half_up(100 * F.col("n") / F.col("total")).alias("percent"))


def latency_percentiles(spark, sf_dir):
    return evaluate.latency(read(spark, sf_dir, "events"), "value", "event_type").withColumn("mean", F.col("mean").cast("double"))


def histogram_buckets(spark, sf_dir):
    return evaluate.histogram(read(spark, sf_dir, "events"), "value", "event_type", bounds=(5.0, 10.0, 50.0, 100.0)).select("event_type", F.col("le").cast("string").alias("le"), "n", F.round("sum", 4).alias("sum"), "count")


def metric_counters(spark, sf_dir):
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.col("k").cast("string"))
    out = evaluate.counters(signals(spark, sf_dir).withColumn("name", F.lit("events_total")).withColumn("one", F.lit(1)), "name", labels, "one")
    return out


def metric_gauges(spark, sf_dir):
    out = evaluate.gauges(signals(spark, sf_dir), "event_type", F.create_map(F.lit("k"), F.col("k").cast("string")), "value", "ts", "event_id")
    return out.withColumnRenamed("value", "last_value")


def confusion_metrics(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return evaluate.confusion(docs, F.col("quality") == 1, F.col("n_chars") > 800, "lang")


def evaluation_rollup(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("run"), "o_orderstatus", "o_totalprice")
    return o.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("passed"), half_up(F.avg("o_totalprice"), 2).alias("mean_price"))


def field_accuracy(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    rows = li.select(
        "l_orderkey",
        F.col("l_returnflag").alias("flag_expected"),
        F.when(F.col("l_quantity") > 45, "X").otherwise(F.col("l_returnflag")).alias("flag_actual"),
        (F.col("l_quantity") <= 45).alias("flag_correct"),
        F.when(F.col("l_discount") > 0.05, F.col("l_linestatus")).alias("status_expected"),
        F.col("l_linestatus").alias("status_actual"),
        (F.col("l_tax") < 0.07).alias("status_correct"),
    )
    long = evaluate.field_rows(rows, ["l_orderkey"], ["flag", "status"])
    a, b = evaluate.field_accuracy(long), evaluate.field_accuracy(long, labelled_only=True)
    return a.withColumn("labelled", F.lit(False)).unionByName(b.withColumn("labelled", F.lit(True)))


def health_score(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    return evaluate.health(e, "ok")


def coverage_matrix(spark, sf_dir):
    nation, kinds = read(spark, sf_dir, "nation").select(F.col("n_name").alias("country")), read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("kind"))
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("kind"), "c_acctbal", "c_custkey")
    return catalog.coverage_matrix(nation, kinds, c.where("c_acctbal > 6000 and c_custkey % 3 = 0"), c.where("c_acctbal < 1000 and c_custkey % 3 = 1"))


def coverage_gaps(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("kind"), "c_acctbal", "c_custkey")
    validators = read(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_name").alias("country"))
    return catalog.coverage_gaps(c.where("c_acctbal > 6000 and c_custkey % 3 = 0").select("country", "kind"), c.where("c_acctbal < 1000").select("country", "kind"), validators, id_kind="BUILDING")


def coverage_rollup(spark, sf_dir):
    return catalog.rollup(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


def registry_summary(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.when(F.col("s_acctbal") > 0, "active").otherwise("suspended").alias("state"), F.array(F.col("s_nationkey"), (F.col("s_nationkey") + 7) % 25).alias("countries"))
    return catalog.registry_summary(s, "state", "countries")


def coverage_stats(spark, sf_dir):
    """Orders as entries: their status, priority and customer's nation."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    m = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("kind"), F.col("c_nationkey").alias("country"), (F.col("o_orderkey") % 3 == 0).alias("tested_real"), (F.col("o_orderkey") % 2 == 0).alias("tested_synthetic"))
    return catalog.coverage_stats(m, flags=("tested_real", "tested_synthetic"))


def registry_stats(spark, sf_dir):
    """Suppliers as sources: life cycle, implementation and access."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, "active").otherwise("suspended").alias("lifecycle"), F.when(k % 3 == 0, "live").otherwise("planned").alias("implementation"), F.when(k % 4 > 0, "public").alias("access"), F.when(k % 5 > 0, F.array(n, (n + 7) % 25)).otherwise(F.array().cast("array<int>")).alias("countries"))
    return catalog.registry_stats(s, "s_suppkey", "countries", ("lifecycle", "implementation", "access"))


def registry_filters(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 10 == 0, F.array(F.lit("global"))).otherwise(F.array(F.col("s_nationkey").cast("string"))).alias("c"))
    return s.where(catalog.serves(F.col("c"), F.lit("7"))).select("s_suppkey")


_STATES = ("DISCOVERED", "UNDER_REVIEW", "APPROVED", "DOWNLOADABLE", "DOWNLOADED", "VALIDATED", "INTEGRATED", "REJECTED", "RESTRICTED", "BLOCKED")


def lifecycle_violations(spark, sf_dir):
    """Events as states of sources, all ten, in the order their users had them."""
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("event_id") * 7 % 10 + 1).cast("int"))
    e = read(spark, sf_dir, "events").withColumn("state", state)
    return rules.lifecycle_violations(e, "user_id", "state", "ts", "event_id").select("event_id", "previous", "state")


def verification_summary(spark, sf_dir):
    """Orders as verification records: counts and rates by status, four averages
    with nulls as 0, counts by type, recent ones, and all 24 hours."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    score = lambda m: F.when(F.col("o_orderkey") % m > 0, F.col("o_orderkey") % m / m)
    at = F.make_timestamp_ntz(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"), (F.col("o_orderkey") % 24).cast("int"), F.lit(0), F.lit(0))
    rows = o.select(status.alias("status"), F.col("o_orderpriority").alias("doc_type"), at.alias("created_at"), score(7).alias("doc"), score(5).alias("face"), score(11).alias("live"), score(3).alias("image"))
    return evaluate.verification_summary(rows, F.lit("1998-08-01 12:00:00").cast("timestamp_ntz"), 30)


def version_at(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    v = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("valid_from"), "event_id")
    from pyspark.sql import Window

    v = v.select("user_id", "valid_from", F.lead("valid_from").over(Window.partitionBy("user_id").orderBy("valid_from", "event_id")).alias("valid_until"), F.col("event_id").alias("version"))
    out = catalog.valid_at(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), v, "user_id", "ts")
    return out.select("event_id", "version")


def parent_with_children(spark, sf_dir):
    o, li = read(spark, sf_dir, "orders").select("o_orderkey"), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return with_children(o, li, "o_orderkey", "l_linenumber", 3).select("o_orderkey", F.coalesce(F.size("children"), F.lit(0)).cast("long").alias("n"), F.col("children")[0]["l_quantity"].alias("first_quantity"))


def filtered_scan(spark, sf_dir):
    return find_many(read(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": MISSING}, [("o_totalprice", False), ("o_orderkey", True)], 50, ["o_orderkey", "o_totalprice"])


def counted(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(where_equal({"o_orderstatus": "O"})).agg(F.count("*").alias("n"))


def newest(spark, sf_dir):
    return find_many(read(spark, sf_dir, "events"), None, [("ts", False), ("event_id", False)], 200, ["event_id", "event_type"])


_COVER = "from customer join nation on c_nationkey = n_nationkey"
QUERIES = {
    "dashboard_summary": (
        summary,
        """select event_type, count(*) total, count(*) filter (ts > (select max(ts) from events) - interval 7 days) recent,
        round(avg(coalesce(value, 0)), 4) avg_value from events group by event_type""",
    ),
    "dashboard_hourly": (hourly, "select hour(ts) as hour, count(*) n from events where ts > (select max(ts) from events) - interval 24 hours group by 1"),
    "dashboard_shares": (shares, "select event_type, floor(100.0::double * count(*) / (select count(*) from events) + 0.5) percent from events group by 1"),
    "latency_percentiles": (latency_percentiles, "select event_type, floor(avg(value) + 0.5) mean, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.95) p95, quantile_disc(value, 0.99) p99, min(value) min, max(value) max from events group by 1"),
    "histogram_buckets": (
        histogram_buckets,
        """select event_type, le, count(*) filter (value <= b) n, round(sum(value), 4) as sum, count(value) as count from events,
        (values ('5.0', 5.0::double), ('10.0', 10.0), ('50.0', 50.0), ('100.0', 100.0), ('Infinity', 'inf'::double)) t(le, b) group by 1, 2""",
    ),
    "metric_counters": (metric_counters, f"""with {SIGNALS_SQL} select 'events_total' as name, '{{"k":"' || k || '","type":"' || event_type || '"}}' labels, count(*) as value from signals group by k, event_type"""),
    "metric_gauges": (metric_gauges, f"""with {SIGNALS_SQL} select event_type, '{{"k":"' || k || '"}}' labels, arg_max(value, (ts, event_id)) last_value from signals group by event_type, k"""),
    "confusion_metrics": (
        confusion_metrics,
        """with c as (select lang, count(*) filter (quality = 1 and n_chars > 800) tp, count(*) filter (quality <> 1 and n_chars <= 800) tn, count(*) filter (quality <> 1 and n_chars > 800) fp, count(*) filter (quality = 1 and n_chars <= 800) fn from documents join labels using (doc_id) group by lang),
        r as (select *, coalesce(tp::double / nullif(tp + fp, 0), 0) p, coalesce(tp::double / nullif(tp + fn, 0), 0) r, coalesce(fp::double / nullif(fp + tn, 0), 0) a, coalesce(fn::double / nullif(fn + tp, 0), 0) b from c)
        select lang, tp, tn, fp, fn, floor((tp + tn)::double / (tp + tn + fp + fn) * 10000.0::double + 0.5) / 10000.0::double accuracy, floor(p * 10000.0::double + 0.5) / 10000.0::double as precision, floor(r * 10000.0::double + 0.5) / 10000.0::double recall,
        floor(coalesce(2 * p * r / nullif(p + r, 0), 0) * 10000.0::double + 0.5) / 10000.0::double f1, floor(a * 10000.0::double + 0.5) / 10000.0::double apcer, floor(b * 10000.0::double + 0.5) / 10000.0::double bpcer, floor((a + b) / 2 * 10000.0::double + 0.5) / 10000.0::double acer from r""",
    ),
    "evaluation_rollup": (evaluation_rollup, "select o_orderkey % 50 run, count(*) n, count(*) filter (o_orderstatus = 'F') passed, floor(avg(o_totalprice) * 100 + 0.5) / 100 mean_price from orders group by 1"),
    "field_accuracy": (
        field_accuracy,
        """with l as (select 'flag' field, l_returnflag expected, l_quantity <= 45 ok from lineitem union all select 'status', case when l_discount > 0.05 then l_linestatus end, l_tax < 0.07 from lineitem)
        select field, count(*) filter (ok) correct, count(*) total, floor(count(*) filter (ok)::double / count(*) * 10000.0::double + 0.5) / 10000.0::double accuracy, false labelled from l group by 1
        union all select field, count(*) filter (ok), count(*), floor(count(*) filter (ok)::double / count(*) * 10000.0::double + 0.5) / 10000.0::double, true from l where expected is not null group by 1""",
    ),
    "health_score": (health_score, "select floor(100.0::double * avg((event_type <> 'error')::int) + 0.5) score, case when floor(100.0::double * avg((event_type <> 'error')::int) + 0.5) = 100 then 'PERFECT HARMONY' when floor(100.0::double * avg((event_type <> 'error')::int) + 0.5) >= 80 then 'GOOD' when floor(100.0::double * avg((event_type <> 'error')::int) + 0.5) >= 60 then 'DEGRADED' else 'CRITICAL' end verdict from events"),
    "coverage_matrix": (
        coverage_matrix,
        f"""with s as (select distinct n_name, c_mktsegment {_COVER} where c_acctbal > 6000 and c_custkey % 3 = 0), t as (select distinct n_name, c_mktsegment {_COVER} where c_acctbal < 1000 and c_custkey % 3 = 1),
        g as (select distinct n.n_name country, c.c_mktsegment kind from nation n, customer c), m as (select country, kind, (country, kind) in (select (n_name, c_mktsegment) from s) has_spec, (country, kind) in (select (n_name, c_mktsegment) from t) has_template from g)
        select *, case when has_spec and has_template then 'full' when has_spec then 'spec_only' when has_template then 'template_only' else 'none' end state from m""",
    ),
    "coverage_gaps": (
        coverage_gaps,
        f"""with s as (select distinct n_name country, c_mktsegment kind {_COVER} where c_acctbal > 6000 and c_custkey % 3 = 0), t as (select distinct n_name country, c_mktsegment kind {_COVER} where c_acctbal < 1000)
        select country, kind, 'template_missing' gap from s where not exists (select 1 from t where t.country = s.country and t.kind = s.kind)
        union select country, kind, 'validator_missing' from s where kind = 'BUILDING' and country not in (select n_name from nation where n_regionkey < 3)""",
    ),
    "coverage_rollup": (coverage_rollup, "select '' as dim, null::varchar as value, count(*) n from orders union all select 'o_orderstatus', o_orderstatus, count(*) from orders group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2"),
    "registry_summary": (registry_summary, "with s as (select case when s_acctbal > 0 then 'active' else 'suspended' end state, s_nationkey a, (s_nationkey + 7) % 25 b from supplier), u as (select state, a c from s union all select state, b from s) select s.state, count(*) sources, (select count(distinct c) from u where u.state = s.state) countries from s group by s.state"),
    "coverage_stats": (
        coverage_stats,
        """with m as (select o_orderstatus state, o_orderpriority kind, c_nationkey country, o_orderkey k from orders join customer on o_custkey = c_custkey),
        a as (select 'state' "by", state, null kind, country, k from m union all select 'kind', null, kind, country, k from m union all select 'all', null, null, country, k from m)
        select "by", state, kind, count(*) entries, count(distinct country) countries, count(*) filter (k % 3 = 0) tested_real, count(*) filter (k % 2 = 0) tested_synthetic from a group by 1, 2, 3""",
    ),
    "registry_stats": (
        registry_stats,
        """with s as (select s_suppkey k, case when s_acctbal > 0 then 'active' else 'suspended' end lifecycle, case when s_suppkey % 3 = 0 then 'live' else 'planned' end implementation, case when s_suppkey % 4 > 0 then 'public' end access, s_nationkey n from supplier),
        c as (select k, n c from s where k % 5 > 0 union all select k, (n + 7) % 25 from s where k % 5 > 0),
        a as (select 'lifecycle' "by", lifecycle as value, k from s union all select 'implementation', implementation, k from s union all select 'access', access, k from s union all select 'all', null, k from s)
        select "by", value, count(distinct a.k) sources, count(distinct c) countries from a left join c on a.k = c.k group by 1, 2""",
    ),
    "registry_filters": (registry_filters, "select s_suppkey from supplier where s_suppkey % 10 = 0 or s_nationkey = 7"),
    "lifecycle_violations": (
        lifecycle_violations,
        """with e as (select *, ['DISCOVERED', 'UNDER_REVIEW', 'APPROVED', 'DOWNLOADABLE', 'DOWNLOADED', 'VALIDATED', 'INTEGRATED', 'REJECTED', 'RESTRICTED', 'BLOCKED'][event_id * 7 % 10 + 1] state from events)
        select event_id, previous, state from (select *, lag(state) over (partition by user_id order by ts, event_id) previous from e) where previous <> state and not case previous
        when 'DISCOVERED' then state in ('UNDER_REVIEW', 'REJECTED', 'BLOCKED') when 'UNDER_REVIEW' then state in ('APPROVED', 'REJECTED', 'RESTRICTED', 'BLOCKED') when 'APPROVED' then state in ('DOWNLOADABLE', 'RESTRICTED', 'REJECTED')
        when 'DOWNLOADABLE' then state in ('DOWNLOADED', 'RESTRICTED', 'BLOCKED') when 'DOWNLOADED' then state in ('VALIDATED', 'DOWNLOADABLE', 'BLOCKED') when 'VALIDATED' then state in ('INTEGRATED', 'DOWNLOADED', 'BLOCKED')
        when 'INTEGRATED' then state in ('VALIDATED', 'DOWNLOADED', 'BLOCKED') when 'REJECTED' then state in ('UNDER_REVIEW', 'BLOCKED') when 'RESTRICTED' then state in ('UNDER_REVIEW', 'APPROVED', 'BLOCKED') else false end""",
    ),
    "verification_summary": (
        verification_summary,
        """with r as (select case o_orderstatus when 'F' then 'verified' when 'O' then 'failed' else 'pending' end status, o_orderpriority t, o_orderdate + o_orderkey % 24 * interval 1 hour c, o_orderkey k from orders), n as (select timestamp '1998-08-01 12:00:00' now),
        rec as (select * from r, n where c > now - interval 30 days), tot as (select count(*) n from r),
        a as (select 'total' as metric, '' as key, n::double as value from tot union all select 'recent', '', count(*) from rec union all select 'count', s, count(*) filter (status = s) from r, (select unnest(['verified', 'failed', 'pending']) s) group by 2
        union all select 'rate', s, floor(100.0::double * count(*) filter (status = s) / count(*) + 0.5) from r, (select unnest(['verified', 'failed']) s) group by 2 union all select 'recent_status', s, (select count(*) from rec where status = s) from (select unnest(['verified', 'failed', 'pending']) s)
        union all select 'average', 'doc', avg(k % 7 / 7.0::double) from r union all select 'average', 'face', avg(k % 5 / 5.0::double) from r union all select 'average', 'live', avg(k % 11 / 11.0::double) from r union all select 'average', 'image', avg(k % 3 / 3.0::double) from r
        union all select 'type', t, count(*) from r group by 2 union all select 'hour', lpad(h::varchar, 2, '0'), (select count(*) from r, n where now - c < interval 24 hours and hour(c) = h) from (select unnest(range(24)) h))
        select metric, key, round(value, 6) as value from a""",
    ),
    "version_at": (
        version_at,
        """with v as (select user_id, ts valid_from, lead(ts) over (partition by user_id order by ts, event_id) valid_until, event_id as version from events where event_type = 'signup')
        select e.event_id, v.version from events e left join v on e.user_id = v.user_id and e.ts >= v.valid_from and (v.valid_until is null or e.ts < v.valid_until) where e.event_type = 'purchase'""",
    ),
    "parent_with_children": (parent_with_children, "select o_orderkey, least(3, count(l_orderkey)) n, arg_min(l_quantity, (l_linenumber, l_quantity)) first_quantity from orders left join lineitem on l_orderkey = o_orderkey group by 1"),
    "filtered_scan": (filtered_scan, "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 50"),
    "counted": (counted, "select count(*) n from orders where o_orderstatus = 'O'"),
    "newest": (newest, "select event_id, event_type from events order by ts desc, event_id desc limit 200"),
}
