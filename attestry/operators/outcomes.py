"""What follows from evidence: decisions with advice, fused modalities, face
matches by quality, signed certificates, delivery of webhooks with back-off."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import canonical
from attestry.functions.numbers import bound, clamp
from attestry.operators import chains, fusion, risk, rules

#: Advice by state; {0} is what the state depends on.
ADVICE = {
    "UNSUPPORTED_DOCUMENT": "This document type or country is not currently supported. Manual verification recommended.",
    "DOCUMENT_MISMATCH": "Critical validation failed: {0}. The document structure is invalid.",
    "INVALID_STRUCTURE": "Critical validation failed: {0}. The document structure is invalid.",
    "EXPIRED": "The document has passed its expiry date. Reject or request a current document.",
    "LIVENESS_INCONCLUSIVE": "Liveness score {0} is below threshold {1}. Request recapture or manual review.",
    "ELECTRONIC_AUTHENTICATION_PASSED": "Electronic chip authentication succeeded. This is the strongest available evidence of document authenticity.",
    "ISSUER_CHECK_CONFIRMED": "The issuing authority's registry confirmed the document. This provides authoritative verification.",
    "VERIFIED_WITH_SUPPORTED_EVIDENCE": "All performed checks passed. The document is verified with the available evidence.",
    "STRUCTURE_VALID_BUT_AUTHENTICITY_UNCONFIRMED": "Document structure is valid (MRZ, cross-field checks passed). However, authenticity is not confirmed — no chip authentication or issuer check was performed.",
    "MANUAL_REVIEW_REQUIRED": "Insufficient evidence for automated decision. Manual review required.",
}
#: Fixed value: advice where the confidence alone asks for a review.
UNSURE = "Overall confidence {0} is below review threshold {1}. Manual verification recommended."
#: States that a person has to look at, whatever the confidence.
REVIEWED = ("UNSUPPORTED_DOCUMENT", "DOCUMENT_MISMATCH", "INVALID_STRUCTURE", "LIVENESS_INCONCLUSIVE", "MANUAL_REVIEW_REQUIRED")

#: Seconds before the second, third and later attempts of a delivery, and attempts of one round.
DELAYS_S, ATTEMPTS = (1, 4, 16), 3


def _filled(template: str, *values: Column) -> Column:
    out = F.lit(template)
    for i, v in enumerate(values):
        out = F.replace(out, F.lit(f"{{{i}}}"), v)
    return out


def two_places(x: Column) -> Column:
    return F.format_string("%.2f", x.cast("double"))


def decision(evidence: str, live: str, unsupported: str, expired: str, confidence: str, least_live: float = 0.6, least_sure: float = 0.65) -> Column:
    """``status``, ``recommendation`` and ``human_review`` of evidence items (check, result).

    A null live score is one that was not taken; a null confidence counts as 0.
    """
    sure = F.coalesce(F.col(confidence).cast("double"), F.lit(0.0))
    broken = F.filter(F.col(evidence), lambda x: (x["result"] == "fail") & (F.contains(x["check"], F.lit("MRZ")) | F.contains(x["check"], F.lit("structure")) | F.contains(x["check"], F.lit("cross_field"))))
    names = F.array_join(F.transform(broken, lambda x: x["check"]), ", ")

    def advised(status: Column) -> Column:
        text = F
        for state, line in ADVICE.items():
            values = (two_places(F.col(live)), F.lit(f"{least_live:g}")) if state == "LIVENESS_INCONCLUSIVE" else (names,) if "{0}" in line else ()
            if state == "MANUAL_REVIEW_REQUIRED":
                text = text.when((status == state) & (sure < least_sure), _filled(UNSURE, two_places(sure), F.lit(f"{least_sure:g}")))
            text = text.when(status == state, _filled(line, *values))
        review = status.isin(*REVIEWED) | ((status == "STRUCTURE_VALID_BUT_AUTHENTICITY_UNCONFIRMED") & (sure < least_sure))
        return F.struct(status.alias("status"), text.alias("recommendation"), review.alias("human_review"))

    return bound(rules.evidence_status(evidence, live, unsupported, expired, least_live), advised)


def written_steps(signals: Mapping[str, Column], result: Column, approve: float = 0.80, review: float = 0.60) -> Column:
    """A decision of ``risk.evaluate`` in five steps: signals, weights, contributions and
    their sum, thresholds, and each reason code with its severity and what it says."""
    lines = lambda items, one: F.array_join(F.transform(items, one), "\n")
    score, factors, codes = result["score"], result["factors"], result["codes"]
    facts = [F.format_string(f"  - {name} = %.4f", value.cast("double")) for name, value in signals.items()]
    weights = [f"  - {name}: weight = {w:.2f}" for name, w in rules.RISK_WEIGHTS.items() if name in signals]
    sum_ = F.array_join(F.transform(factors, lambda f: F.format_string("%.4f", f["contribution"])), " + ")
    place = F.when(score >= approve, "score meets or exceeds the APPROVE threshold.").when(score >= review, "score falls in REVIEW range (between review and approve).").otherwise("score below REVIEW threshold → REJECT path.")
    parts = [
        [F.lit("Step 1 — Gathered signals:"), *facts],
        [F.lit("\n".join(["Step 2 — Applied fusion weights:", *weights]))],
        [F.lit("Step 3 — Computed weighted contribution per factor:"), lines(factors, lambda f: F.format_string("  - %s: %.4f × %.2f = %.4f", f["factor"], f["value"], f["weight"], f["contribution"])), F.concat(F.lit("  weighted_sum = "), sum_, F.format_string(" = %.4f", score))],
        [F.lit(f"Step 4 — Compared to decision thresholds:\n  - approve threshold: {approve:g}\n  - review threshold: {review:g}"), F.concat(F.format_string("  - score %.4f ", score), F.when(score >= approve, "≥").otherwise("<"), F.lit(" approve_threshold")), F.concat(F.lit("  → "), place)],
        [F.concat(F.lit("Step 5 — Final decision: "), F.upper(result["decision"])), F.concat(F.lit("  Reason codes: "), F.when(F.size(codes) > 0, F.array_join(codes, ", ")).otherwise("(none)")), F.when(F.size(codes) > 0, lines(codes, lambda c: F.concat(F.lit("    • ["), F.rpad(F.upper(risk.severity(c)), 8, " "), F.lit("] "), c, F.lit(": "), risk.description(c))))],
    ]
    return F.concat_ws("\n\n", *[F.concat_ws("\n", *p) for p in parts])


def fused(scores: Mapping[str, tuple[Column, Column]], weights: Column | None = None) -> Column:
    """Modalities (score, confidence; null if not given) put together.

    A struct of ``score``, ``conflict``, ``decision``, ``risk``, ``count``, ``missing`` names,
    the ``top`` modality by weight and score, and ``disagreement``.  ``weights`` are in the
    order of ``scores``; no modality at all is rejected with score 0.
    """
    given = [F.when(s.isNotNull(), F.struct(F.lit(n).alias("name"), clamp(s.cast("double")).alias("score"), clamp(F.coalesce(c.cast("double"), F.lit(0.0))).alias("confidence"), (F.lit(0.0) if weights is None else weights[i]).alias("weight"))) for i, (n, (s, c)) in enumerate(scores.items())]
    missing = F.array_compact(F.array(*[F.when(s.isNull(), n) for n, (s, _) in scores.items()]))

    def put(items: Column) -> Column:
        # The last of the struct keeps the first of equals.
        top = F.array_max(F.transform(items, lambda x, i: F.struct((x["weight"] * x["score"]).alias("by"), (-i).alias("place"), x["name"].alias("name"))))["name"]

        def judged(b: Column) -> Column:
            real, conflict = clamp(b["real"]), clamp(b["conflict"])
            return F.struct(real.alias("score"), conflict.alias("conflict"), fusion.fused_decision(real, conflict).alias("decision"), fusion.risk_level(real, conflict).alias("risk"), F.size(items).alias("count"), missing.alias("missing"), top.alias("top"), fusion.disagreement(items).alias("disagreement"))

        return bound(fusion.combine_beliefs(fusion.evidence_of(items)), judged)

    none = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("conflict"), F.lit("reject").alias("decision"), F.lit("critical").alias("risk"), F.lit(0).alias("count"), missing.alias("missing"), F.lit(None).cast("string").alias("top"), F.lit(0.0).alias("disagreement"))
    return bound(F.array_compact(F.array(*given)), lambda items: F.when(F.size(items) > 0, put(items)).otherwise(none))


def face_decision(similarity: Column, quality: Column, other_quality: Column) -> Column:
    """``match``, ``threshold`` and ``reason`` of a cosine similarity: the poorer image
    sets the threshold, from 0.36 at full quality to 0.42.  No similarity is no match."""
    limit = F.lit(0.36) + (1.0 - F.least(quality, other_quality)) * 0.06

    def judged(t: Column) -> Column:
        fine = F.coalesce(similarity >= t, F.lit(False))
        reason = F.when(similarity.isNull(), "no_embedding").when(similarity < 0.1, "no_face_match").when(fine, "match").otherwise("below_threshold")
        return F.struct(fine.alias("match"), F.when(similarity.isNull(), 0.4).otherwise(F.round(t, 4)).alias("threshold"), reason.alias("reason"))

    return bound(limit, judged)


def certified(rows: DataFrame, payload: str, issued: str, secret: str, days: int = 90) -> DataFrame:
    """Adds ``body`` (canonical JSON of the payload, with issue and expiry) and its HMAC ``signature``."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    at = F.col(issued).cast("timestamp")
    whole = F.struct(F.col(payload).alias("payload"), stamp(at).alias("issuedAt"), stamp(at + F.make_interval(days=F.lit(days))).alias("expiresAt"))
    kind = rows.select(whole.alias("w")).schema["w"].dataType
    out = rows.withColumn("body", canonical.canonical(whole, kind))
    return out.withColumn("signature", chains.signed(secret)("body"))


def certificate_state(rows: DataFrame, secret: str, as_of: Column) -> DataFrame:
    """Adds ``state``: forged, expired (after the expiry that the body names) or valid."""
    expiry = F.to_timestamp(F.get_json_object("body", "$.expiresAt"), "yyyy-MM-dd'T'HH:mm:ss.SSSX")
    mine = chains.signed(secret)("body")
    state = F.when(~F.coalesce(mine == F.col("signature"), F.lit(False)) | expiry.isNull(), "forged").when(as_of > expiry, "expired").otherwise("valid")
    return rows.withColumn("state", state)


def delivered(events: DataFrame, outcomes: str = "outcomes", created: str = "created_us", replayed: str | None = None, attempts: int = ATTEMPTS, delays: tuple[int, ...] = DELAYS_S) -> DataFrame:
    """Adds ``status``, ``attempts``, ``ended_us``: deliveries by the outcomes of their attempts, in order.

    An event is tried until it gets through, ``attempts`` times at most, the waits
    between them being ``delays`` seconds.  A dead letter with a time in ``replayed`` is
    tried anew from then on, with the outcomes that follow, and its attempts go on
    counting.  An attempt without an outcome has failed.
    """
    waits = F.array(*[F.lit(sum(delays[min(i, len(delays) - 1)] for i in range(k))).cast("long") for k in range(attempts)])

    def round_(first: int, start: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(attempts - 1))
        through = F.filter(places, lambda i: F.coalesce(F.get(F.col(outcomes), i + first), F.lit(False)))
        return bound(F.get(through, F.lit(0)), lambda hit: F.struct(hit.isNotNull().alias("ok"), (F.coalesce(hit + 1, F.lit(attempts)) + first).cast("long").alias("n"), (start + F.get(waits, F.coalesce(hit, F.lit(attempts - 1))) * 1_000_000).alias("at")))

    one = round_(0, F.col(created))
    two = round_(attempts, F.col(replayed)) if replayed else None

    def ended(r: Column) -> Column:
        last = bound(F.when(~r["ok"] & F.col(replayed).isNotNull(), two).otherwise(r), lambda x: x) if replayed else r
        return bound(last, lambda x: F.struct(F.when(x["ok"], "delivered").otherwise("dead_letter").alias("status"), x["n"].alias("attempts"), x["at"].alias("ended_us")))

    return events.withColumn("_d", bound(one, ended)).select("*", "_d.*").drop("_d")


def endpoint_failures(deliveries: DataFrame, endpoint: str, order: list[str]) -> DataFrame:
    """``endpoint``, ``failures``: dead letters since the endpoint's last delivery."""
    w = Window.partitionBy(endpoint)
    at = F.struct(*order)
    rows = deliveries.withColumn("_last", F.max(F.when(F.col("status") == "delivered", at)).over(w))
    since = (F.col("status") == "dead_letter") & (F.col("_last").isNull() | (at > F.col("_last")))
    return rows.groupBy(endpoint).agg(F.count_if(since).alias("failures"))


def latest_devices(events: DataFrame, key: str, device: str, ts: str = "ts", order: str = "event_id", last: int = 5) -> DataFrame:
    """``key``, ``devices`` (distinct ones among a key's ``last`` events with a device) and ``switched``."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(order))
    recent = events.where(F.col(device).isNotNull()).select(key, device, F.row_number().over(w).alias("_r")).where(F.col("_r") <= last)
    return recent.groupBy(key).agg(F.count_distinct(device).alias("devices"), F.count("*").alias("_n")).select(key, "devices", ((F.col("devices") > 1) & (F.col("_n") > 1)).alias("switched"))
