"""Registered queries over training status, registries, rules, alerts and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import alerts as A, components as CO, report as RP, rules as RU, scoring as SC, training as TR
from ..session import shared_dir
from ..sources import components as CS, stores
from .fixtures import OWN_ORIGIN, duck, table, view


def _status(spark, sf):
    return TR.evaluate_status(view(spark, sf, "device_activity"), "device_no")


def _counts(df):
    return df.withColumns(
        {
            "hours": F.size("distinct_hour_buckets").cast("long"),
            "days": F.size("distinct_day_buckets").cast("long"),
            "current_size": F.col("current_size").cast("long"),
        }
    )


def activity_buckets(spark, sf):
    frames = view(spark, sf, "packets").select("seq", F.floor(F.col("ts_us") / 1_000_000).alias("s"))
    return frames.select("seq", S.hour_bucket(F.col("s")).alias("hour_bucket"), S.day_bucket(F.col("s")).alias("day_bucket"))


def training_progress(spark, sf):
    return _counts(_status(spark, sf)).select("device_no", "current_size", "hours", "days", "progress", "description")


def decide_action(spark, sf):
    status = _status(spark, sf)
    return status.select(
        "device_no", "progress", TR.decide_action(F.col("progress")).alias("action"),
        TR.decide_action(F.col("progress"), False).alias("action_without_training"),
    )


def _registry(spark, sf):
    """The registry state taken apart into its four tables."""
    state = view(spark, sf, "registry_state")
    digest = F.when(F.col("model_equals_base"), "base").otherwise(F.concat(F.lit("model-"), F.col("device_no").cast("string")))
    return {
        "status": state.select("device_no", "progress", "current_size"),
        "thresholds": state.filter("threshold is not null").select("device_no", "threshold", "version"),
        "models": state.filter("has_model").select("device_no", digest.alias("digest")),
        "datasets": state.filter("has_dataset").select("device_no", F.col("dataset_readable").alias("readable")),
    }


def _audited(spark, sf):
    return TR.audit(**_registry(spark, sf), base_digest="base", key="device_no")


def registry_audit(spark, sf):
    return _audited(spark, sf).select("device_no", "reason")


def reset_devices(spark, sf):
    broken = _audited(spark, sf).filter("reason is not null").select("device_no")
    return TR.initial_components(broken, "base").select(
        "device_no", "threshold", "version", "digest", "current_size", "progress", "description"
    )


def reset_components(spark, sf):
    """The registry in one store of four tables; what the audit rejects and what is new starts over in one commit. Returns
    all devices' components as the commit after it shows them."""
    state = view(spark, sf, "registry_state").withColumn("device_mac", F.col("device_no").cast("string"))
    none = F.array().cast("array<bigint>")
    own = F.when(F.col("model_equals_base"), "base").otherwise(F.concat(F.lit("model-"), "device_mac"))
    store = CS.ComponentStore(spark, f"{shared_dir(spark)}/components-{uuid.uuid4().hex}", buckets=16)
    store.commit({
        "status": CS.put(state.select(
            "device_mac", F.col("current_size").cast("long").alias("current_size"), none.alias("distinct_hour_buckets"),
            none.alias("distinct_day_buckets"), "progress", F.lit("as it was").alias("description"),
        )),
        "thresholds": CS.put(state.filter("threshold is not null").select("device_mac", "threshold", "version")),
        "models": CS.put(state.filter("has_model").select("device_mac", own.alias("digest"), F.array(F.lit(1.0)).alias("params"))),
        "datasets": CS.put(state.filter("has_dataset and current_size > 0").select("device_mac", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("x"))),
    })
    customers = table(spark, sf, "orders").select((F.col("o_custkey") * 2).cast("string").alias("device_mac"))
    CO.ensure(store, customers, "base", [0.5])
    rows = store.read("datasets").groupBy("device_mac").agg(F.count(F.lit(1)).alias("n_rows"))
    after = store.read("status").join(store.read("thresholds"), "device_mac", "full").join(store.read("models"), "device_mac", "full")
    return after.join(rows, "device_mac", "full").select(
        "device_mac", "progress", "current_size", "description", "threshold", "version", "digest",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


def new_devices(spark, sf):
    registry = table(spark, sf, "orders").select(F.col("o_custkey").alias("device_no"))
    return TR.new_devices(registry, view(spark, sf, "registry_state").filter("progress > 0"), "device_no")


def stale_thresholds(spark, sf):
    parts = _registry(spark, sf)
    return TR.stale_threshold_action(parts["status"], parts["thresholds"], parts["datasets"], "device_no").select(
        "device_no", "threshold_action"
    )


def threshold_upsert(spark, sf):
    state = view(spark, sf, "registry_state").filter("threshold is not null")
    text = F.when(
        F.col("version") == "0.8", F.to_json(F.struct("threshold", "version"))
    ).otherwise(F.col("threshold").cast("string"))
    old = stores.migrate_thresholds(state.select(F.col("device_no").cast("string").alias("device_mac"), text.alias("value")))
    new = state.filter("device_no % 10 = 0").select(
        F.col("device_no").cast("string").alias("device_mac"), (F.col("threshold") * 2).alias("threshold"),
        F.lit("0.9").alias("version"),
    )
    return stores.upsert(old, new, ["device_mac"]).select("device_mac", F.round("threshold", 6).alias("threshold"), "version")


def status_upsert(spark, sf):
    status = _status(spark, sf).withColumnRenamed("device_no", "device_mac")
    status = status.withColumn("device_mac", F.col("device_mac").cast("string"))
    old = stores.status_from_json(stores.status_to_json(status))
    new = TR.complete_training(old.filter("progress >= 0.95"))
    return _counts(stores.upsert(old, new, ["device_mac"])).select(
        "device_mac", "current_size", "hours", "days", "progress", "description"
    )


def status_view(spark, sf):
    status = _status(spark, sf).withColumn("device_mac", F.concat(F.lit("aa-bb-cc-00-00-"), F.col("device_no").cast("string")))
    return RP.status_view(status).select("mac", F.round("progress", 6).alias("progress"), "description")


# --- rules and alerts -------------------------------------------------------


def rules_table(spark, sf):
    rules = RU.parse_rules(view(spark, sf, "rules_text"))
    first = F.col("contents")[0]
    return rules.select(
        "rule_sid", "action", "proto", "src", "dst", "msg", F.col("enabled").cast("long").alias("enabled"),
        first["text"].alias("content"), first["nocase"].cast("long").alias("nocase"),
        F.try_element_at("metadata", F.lit("signature_severity")).alias("severity"),
        F.try_element_at("metadata", F.lit("confidence")).alias("confidence"),
    )


def rule_select(spark, sf):
    return RU.select_rules(view(spark, sf, "rules_text"), OWN_ORIGIN).select("sid", "line")


def rule_count(spark, sf):
    return RU.rule_count(RU.select_rules(view(spark, sf, "rules_text"), OWN_ORIGIN))


def rule_match(spark, sf):
    events = view(spark, sf, "web_events").select(
        F.col("page_id").alias("event_id"),
        F.lit("http").alias("proto"),
        (F.lit(3232235786) + F.col("page_id") % 10).alias("src_ip"),
        F.when(F.col("page_id") % 4 == 0, 167772161).otherwise(F.lit(16777216) + F.col("page_id")).alias("dst_ip"),
        F.lit(50000).alias("event_src_port"),
        F.lit(80).alias("event_dst_port"),
        F.create_map(F.lit("http.header"), F.col("host"), F.lit("http.request_line"), F.col("request_line")).alias("buffers"),
    )
    return RU.rule_hits(events, RU.parse_rules(view(spark, sf, "rules_text"))).select("rule_sid", "msg", "hits")


def _alerts(spark, sf):
    rows = view(spark, sf, "alert_events").withColumn("macs", F.when(F.col("has_ether"), F.array("src_mac", "dest_mac")))
    return A.alert_device(A.only_alerts(rows), view(spark, sf, "device_registry"))


def alert_device(spark, sf):
    return _alerts(spark, sf).select("seq", "signature", "device_mac")


def alert_rollup(spark, sf):
    return A.alert_rollup(_alerts(spark, sf))


def alert_rollup_compat(spark, sf):
    return A.alert_rollup_compat(_alerts(spark, sf))


# --- reports ----------------------------------------------------------------


def _verdicts(spark, sf):
    counts = SC.anomaly_counts(SC.anomaly_flags(view(spark, sf, "scores").withColumn("threshold", F.lit(0.1))))
    failed = F.col("device_mac") == "aa-bb-cc-00-00-05"
    state = counts.filter("device_mac <> 'aa-bb-cc-00-00-06'").select(
        "device_mac",
        F.when(F.col("device_mac") == "aa-bb-cc-00-00-04", TR.COLLECT).otherwise(TR.INFER).alias("action"),
        "num_anomalies",
        F.when(failed, "worker failed").alias("error"),
    )
    return RP.verdict(state)


def verdict(spark, sf):
    return _verdicts(spark, sf).select("device_mac", "type", "description", F.round("score", 2).alias("score"))


def device_report(spark, sf):
    status = _status(spark, sf)
    done = F.when(F.col("device_no") % 3 == 0, 1.0).otherwise(F.col("progress"))
    state = status.withColumn("progress", done).withColumns(
        {
            "device_mac": F.concat(F.lit("aa-bb-cc-00-00-"), F.col("device_no").cast("string")),
            "action": TR.decide_action(F.col("progress")),
            "error": F.when(F.col("device_no") % 13 == 12, "worker failed"),
            "num_anomalies": F.col("current_size") % 3,
            "processed_at": F.lit("2024-01-01T00:00:00Z"),
            "threshold": F.lit(0.02),
            "model": F.col("description").cast("binary"),
        }
    )
    ml = RP.device_report(state)
    return ml.select(
        "device_mac", "ml.action", "ml.error", F.col("ml.num_anomalies").cast("long").alias("num_anomalies"),
        "ml.first_occurrence", F.col("ml.dataset_size").cast("long").alias("dataset_size"),
        F.round("ml.progress", 6).alias("progress"), "ml.status_description",
        F.size("ml.distinct_hour_buckets").cast("long").alias("hours"), "ml.threshold", "ml.model_base64",
    )


def device_report_join(spark, sf):
    alerts = A.as_report_entries(A.alert_rollup(_alerts(spark, sf)))
    joined = RP.join_reports(view(spark, sf, "device_registry"), alerts, _verdicts(spark, sf))
    total = F.aggregate("suricata", F.lit(0).cast("long"), lambda a, x: a + x["number_occurrences"])
    return joined.select(
        "mac", F.size("suricata").cast("long").alias("signatures"), total.alias("alerts"),
        F.col("ml.type").alias("ml_type"), F.col("ml.description").alias("ml_description"),
        F.round("ml.score", 2).alias("ml_score"),
    )


def error_streak(spark, sf):
    runs = RP.error_streak(view(spark, sf, "capture_runs"), ["site_id"], "run_seq")
    return runs.select("site_id", "run_seq", F.col("streak").cast("long").alias("streak"), F.col("raises").cast("long").alias("raises"))


QUERIES = {
    f.__name__: f
    for f in (
        activity_buckets, training_progress, decide_action, registry_audit, reset_devices, reset_components, new_devices, stale_thresholds,
        threshold_upsert, status_upsert, status_view, rules_table, rule_select, rule_count, rule_match, alert_device,
        alert_rollup, alert_rollup_compat, verdict, device_report, device_report_join, error_streak,
    )
}

# --- DuckDB twins -----------------------------------------------------------

_PROGRESS = """sums as (select device_no, sum(windows)::bigint as current_size, count(distinct hour_bucket) as hours,
 count(distinct day_bucket) as days from device_activity group by 1),
tracks as (select *, 0.95::double * greatest(least(current_size / 4400, 1), least(days / 2, 1) * least(hours / 16, 1) * least(current_size / 1500, 1),
  least(days / 4, 1) * least(current_size / 1500, 1)) as p from sums),
done as (select * exclude (p), round_even(case when current_size > 0 then greatest(p, 0.01::double) else p end, 2) as progress from tracks),
status as (select *, case when progress = 1 then 'Training complete' when progress >= 0.95::double then 'Training in progress'
 when days = 0 then 'No activity observed yet' when days > 1 and days * hours < days * 6 then 'Device used too rarely'
 when hours * 30 < 1500 then 'Produces too little data' else 'Data collection ongoing' end as description from done)"""

_ACTION = "case when {p} < 1 then case when {p} >= 0.95::double then 'TRAIN' else 'COLLECT' end else 'INFER' end"

_AUDIT = """audited as (select *, case when threshold is null then 'no threshold'
 when progress = 1 and not has_model then 'complete without model'
 when progress = 1 and model_equals_base then 'complete with base model'
 when progress = 1 and threshold = 0.0001::double then 'complete with default threshold'
 when progress > 0 and progress < 1 and current_size = 0 then 'in progress with empty dataset'
 when progress > 0 and progress < 1 and not has_dataset then 'in progress without dataset'
 when progress > 0 and progress < 1 and not dataset_readable then 'in progress with unreadable dataset'
 when progress = 0 and current_size <> 0 then 'not started with data'
 when progress = 0 and not has_dataset then 'not started without dataset'
 when progress = 0 and not has_model then 'not started without model'
 when progress = 0 and not model_equals_base then 'not started with changed model'
 when progress = 0 and threshold <> 0.0001::double then 'not started with own threshold' end as reason from registry_state)"""

_SELECTED = f"""selected as (select * from rules_text
 where not regexp_matches(line, '{RU.EXCLUDED}', 'i')
 and regexp_matches(line, '{OWN_ORIGIN}|{RU.ORIGINS}', 'i') and regexp_matches(line, '{RU.SEVERE}', 'i'))"""

_ATTRIBUTED = """alerts as (select a.*, (select arg_min(r.device_mac, r.position) from device_registry r
  where replace(r.device_mac, '-', ':') in (a.src_mac, a.dest_mac)) as device_mac
 from alert_events a where event_type = 'alert' and has_ether),
rollup as (select device_mac, signature, arg_min(ts_us, seq) as first_occurrence, count(*) as number_occurrences from alerts group by 1, 2)"""

_VERDICT = """found as (select device_mac, count(*) filter (row_number >= 16 and score > 0.1::double and above >= 4
   and ((mean > 0.1::double and above >= 5.44::double) or above >= 8)) as n
 from (select *, row_number() over (partition by device_mac order by score_seq) as row_number, avg(score) over f as mean,
  sum((score > 0.1::double)::int) over f as above from scores
  window f as (partition by device_mac order by score_seq rows between 15 preceding and current row)) group by 1),
verdicts as (select device_mac, case when kind = 'found' then 'Alert' else 'Normal' end as type,
 case kind when 'error' then 'Error occured' when 'found' then n || ' Anomalies detected' when 'clean' then 'No Anomalies detected' else '' end as description,
 round(case kind when 'found' then 50 + u * 49 when 'clean' then u * 49.99::double else 0 end, 2) as score
 from (select *, ('0x' || md5(device_mac)[1:8])::bigint / 4294967296::double as u,
  case when device_mac like '%5' then 'error' when device_mac like '%4' then 'collect' when n > 0 then 'found' else 'clean' end as kind
  from found where device_mac not like '%6'))"""

ORACLE = {
    "activity_buckets": f"""with {duck('packets')} select seq, ts_us // 3600000000 as hour_bucket, ts_us // 86400000000 as day_bucket from packets""",
    "training_progress": f"with {duck('device_activity')}, {_PROGRESS} select * from status",
    "decide_action": f"""with {duck('device_activity')}, {_PROGRESS} select device_no, progress, {_ACTION.format(p='progress')} as action,
 'INFER' as action_without_training from status""",
    "registry_audit": f"with {duck('registry_state')}, {_AUDIT} select device_no, reason from audited",
    "reset_devices": f"""with {duck('registry_state')}, {_AUDIT} select device_no, 0.0001::double as threshold, '0.9' as version, 'base' as digest,
 0::bigint as current_size, 0::double as progress, 'Data collection ongoing' as description from audited where reason is not null""",
    "reset_components": f"""with {duck('registry_state')},
stored as (select *, has_dataset and current_size > 0 as kept, case when has_model then case when model_equals_base then 'base' else 'model-' || device_no end end as digest,
 case when current_size = 0 then true when has_dataset then true end as readable from registry_state),
judged as (select *, case when threshold is null then true
  when progress = 1 then digest is null or digest = 'base' or threshold = 0.0001
  when progress > 0 then current_size = 0 or readable is null
  else current_size <> 0 or readable is null or digest is null or digest <> 'base' or threshold <> 0.0001 end as broken from stored),
fresh as (select distinct o_custkey * 2 as device_no from orders where o_custkey * 2 not in (select device_no from registry_state)
 union select device_no from judged where broken)
select device_no::varchar as device_mac, 0::double as progress, 0::bigint as current_size, 'Data collection ongoing' as description,
 0.0001::double as threshold, '0.9' as version, 'base' as digest, 0::bigint as n_rows from fresh
union all select device_no::varchar, progress::double, current_size::bigint, 'as it was', threshold::double, version, digest, case when kept then 3 else 0 end::bigint
from judged where not broken""",
    "new_devices": f"""with {duck('registry_state')} select distinct o_custkey as device_no from orders
 where o_custkey not in (select device_no from registry_state where progress > 0)""",
    "stale_thresholds": f"""with {duck('registry_state')} select device_no, case when threshold is null then 'reset' when version = '0.9' then 'keep'
 when progress <> 1 then 'bump' when not has_dataset then 'reset' else 'recompute' end as threshold_action from registry_state""",
    "threshold_upsert": f"""with {duck('registry_state')} select device_no::varchar as device_mac,
 round(case when device_no % 10 = 0 then threshold * 2 else threshold end, 6) as threshold,
 case when device_no % 10 = 0 then '0.9' when version = '0.8' then '0.8' else '0' end as version
from registry_state where threshold is not null""",
    "status_upsert": f"""with {duck('device_activity')}, {_PROGRESS} select device_no::varchar as device_mac, current_size, hours, days,
 case when progress >= 0.95::double then 1.0::double else progress end as progress,
 case when progress >= 0.95::double then 'Training complete' else description end as description from status""",
    "status_view": f"""with {duck('device_activity')}, {_PROGRESS} select upper('aa:bb:cc:00:00:') || device_no as mac,
 round(progress * 100, 6) as progress, description from status""",
    "rules_table": f"""with {duck('rules_text')}
select sid as rule_sid, 'alert' as action, regexp_extract(line, 'alert (\\w+)', 1) as proto, '$HOME_NET' as src, '$EXTERNAL_NET' as dst,
 regexp_extract(line, 'msg:"([^"]*)"', 1) as msg, (line not like '#%')::int::bigint as enabled,
 regexp_extract(line, 'content:"([^"]*)"', 1) as content, contains(line, 'nocase')::int::bigint as nocase,
 regexp_extract(line, 'signature_severity (\\w+)', 1) as severity, regexp_extract(line, 'confidence (\\w+)', 1) as confidence from rules_text""",
    "rule_select": f"with {duck('rules_text')}, {_SELECTED} select sid, line from selected",
    "rule_count": f"with {duck('rules_text')}, {_SELECTED} select count(*) filter (line not like '#%') as enabled_rules from selected",
    "rule_match": f"""with {duck('rules_text', 'web_events')},
hit as (select count(*) as hits from web_events where page_id % 4 <> 0 and contains(lower(host || chr(10) || request_line), 'ther'))
select sid as rule_sid, regexp_extract(line, 'msg:"([^"]*)"', 1) as msg, hits from rules_text, hit
where line like 'alert http%' and hits > 0""",
    "alert_device": f"with {duck('alert_events', 'device_registry')}, {_ATTRIBUTED} select seq, signature, device_mac from alerts",
    "alert_rollup": f"with {duck('alert_events', 'device_registry')}, {_ATTRIBUTED} select * from rollup",
    "alert_rollup_compat": f"""with {duck('alert_events', 'device_registry')}, {_ATTRIBUTED},
marked as (select *, signature = first_value(signature) over (partition by device_mac order by seq) as is_first from alerts)
select device_mac, signature, min(seq) as seq, arg_min(ts_us, seq) as first_occurrence, count(*) as number_occurrences
from marked where is_first group by 1, 2
union all select device_mac, signature, seq, ts_us, 1 from marked where not is_first""",
    "verdict": f"with {duck('scores')}, {_VERDICT} select device_mac, type, description, score from verdicts",
    "device_report": f"""with {duck('device_activity')}, {_PROGRESS},
s as (select *, case when device_no % 3 = 0 then 1 else progress end as p, device_no % 13 = 12 as bad, current_size % 3 as na from status),
a as (select *, {_ACTION.format(p='p')} as action from s)
select 'aa-bb-cc-00-00-' || device_no as device_mac, action, case when bad then 'worker failed' end as error,
 case when not bad and action = 'INFER' then na end as num_anomalies,
 case when not bad and action = 'INFER' and na > 0 then '2024-01-01T00:00:00Z' end as first_occurrence,
 case when not bad and action = 'COLLECT' then current_size end as dataset_size,
 case when not bad and action = 'COLLECT' then round(p * 100, 6) end as progress,
 case when not bad and action = 'COLLECT' then description end as status_description,
 case when not bad and action = 'COLLECT' then hours end as hours,
 case when not bad and action = 'TRAIN' then 0.02::double end as threshold,
 case when not bad and action = 'TRAIN' then base64(encode(description)) end as model_base64 from a""",
    "device_report_join": f"""with {duck('alert_events', 'device_registry', 'scores')}, {_ATTRIBUTED}, {_VERDICT}
select upper(replace(r.device_mac, '-', ':')) as mac, count(u.signature) as signatures, coalesce(sum(u.number_occurrences), 0)::bigint as alerts,
 coalesce(any_value(v.type), 'Normal') as ml_type, coalesce(any_value(v.description), 'No data') as ml_description,
 coalesce(any_value(v.score), 0)::double as ml_score
from device_registry r left join rollup u on u.device_mac = r.device_mac left join verdicts v on v.device_mac = r.device_mac group by 1""",
    "error_streak": f"""with {duck('capture_runs')}, g as (select *, sum(ok::int) over (partition by site_id order by run_seq) as grp from capture_runs),
p as (select *, case when ok then 0 else row_number() over (partition by site_id, grp, ok order by run_seq) end as streak from g)
select site_id, run_seq, streak, (streak > 0 and streak % 3 = 0)::int::bigint as raises from p""",
}
