"""Registered query over whole captures: from packets and alerts to one report per capture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capture_report as CR, features as FT, models as M, report as RP, traffic as T
from . import packet_queries as PQ, pipeline, source_queries as SQ
from .fixtures import BASE_US, DUCK_US, SPARK_US, VIEWS, duck, table, view

# A device is silent in one capture, another one is heard for less than a window in another.
HEARD = (
    "not (capture_id % 3 = 1 and device_mac = 'aa-bb-cc-00-00-03') and not (capture_id % 3 = 2 and device_mac = 'aa-bb-cc-00-00-04'"
    f" and (ts_us - {BASE_US}) % 1728000000 >= 50000000)"
)
# One device has no model, one collects data, one waits for its training.
WITHOUT_MODEL = "aa-bb-cc-00-00-05"
PROGRESS = "case when device_mac = 'aa-bb-cc-00-00-06' then 0.5e0 when device_mac = 'aa-bb-cc-00-00-07' then 0.96e0 else 1.0e0 end"
THRESHOLD = 0.155
CAPTURE_OF_ALERT = f"cast(floor((ts_us - {BASE_US}) / 500 / 1728000000) as bigint)"


def _registry(spark, sf) -> pipeline.Registry:
    devices = view(spark, sf, "device_registry").withColumn("site_id", F.lit(0).cast("long"))
    one = devices.filter(F.col("device_mac") != WITHOUT_MODEL).select(
        "device_mac", F.lit(0).cast("long").alias("vec_seq"), F.array_repeat(F.lit(0.0), 45).alias("vector")
    )
    return pipeline.Registry(
        devices=devices,
        status=devices.select("device_mac", F.expr(PROGRESS).alias("progress")),
        models=M.flat_models(M.layer_table(one)),
        thresholds=devices.select("device_mac", F.lit(THRESHOLD).alias("threshold")),
    )


def capture_report(spark, sf):
    """A row for each device of each good capture, one for each failed capture; the last capture is unreadable and its
    rule analysis has failed as well."""
    registry = _registry(spark, sf)
    packets = PQ._registered(spark, sf).filter(HEARD)
    seen = view(spark, sf, "packets").select("capture_id")
    broken = seen.agg((F.max("capture_id") + 1).alias("capture_id"))
    captures = seen.distinct().unionByName(broken).withColumn("site_id", F.lit(0).cast("long"))
    labelled = packets.select("capture_id", F.lit("accepted").alias("disposition"), F.col("packet_length").alias("frame_len"))
    failures = broken.withColumn("read_error", F.lit("truncated record header"))
    analysis = pipeline.Analysis(
        packets=packets,
        totals=T.capture_totals(labelled, captures, failures),
        traffic=T.external_ip_traffic(packets, PQ._geo(spark, sf), ["capture_id", "device_mac"]),
        features=FT.window_features(packets),
    )
    rules = view(spark, sf, "rules_text").agg(F.sum(F.when(F.col("line").startswith("#"), 0).otherwise(1)).alias("rules"))
    runs = captures.join(broken.withColumn("rule_error", F.lit("engine failed")), "capture_id", "left").crossJoin(rules).select(  # one row
        "capture_id", "rule_error", F.create_map(F.lit("suricataTotalRules"), F.col("rules").cast("string")).alias("rule_statistics")
    )
    events = view(spark, sf, "alert_events").withColumn("capture_id", F.expr(CAPTURE_OF_ALERT)).withColumn(
        "macs", F.when(F.col("has_ether"), F.array("src_mac", "dest_mac"))
    )
    reports = pipeline.capture_report(captures, analysis, runs, events, registry)
    found = reports.select("capture_id", "result", "statistics", F.explode_outer("detections").alias("d"))
    sent = F.from_json(F.col("statistics")["devices"], "array<struct<mac:string,data_volume:struct<packet_count:bigint>>>")
    own = F.filter(sent, lambda x: x["mac"] == F.col("d.mac"))
    total = F.aggregate("d.suricata", F.lit(0).cast("long"), lambda a, x: a + x["number_occurrences"])
    return found.select(
        "capture_id", "result.status", "result.message", "d.mac",
        F.size("d.suricata").cast("long").alias("signatures"), total.alias("alerts"),
        F.col("d.ml.type").alias("ml_type"), F.col("d.ml.description").alias("ml_description"), F.round("d.ml.score", 2).alias("ml_score"),
        F.get(own, F.lit(0))["data_volume"]["packet_count"].alias("packets"),
        *[F.col("statistics")[k].cast("long").alias(n) for k, n in (("totalBytes", "total_bytes"), ("packets", "all_packets"), ("suricataTotalRules", "rules"))],
    )


QUERIES = {f.__name__: f for f in (capture_report,)}

# --- DuckDB twin ------------------------------------------------------------

_HEARD = f"heard as ({VIEWS['packets'].format(us=DUCK_US)}),\npackets as (select * from heard where {HEARD})"
_FEATURES = PQ.features_sql(f"{_HEARD}, {duck('device_registry')}", digits=None)
_NET = ", ".join(SQ._layer(l, o, i, l not in M.LINEAR_LAST) for l, (o, i) in enumerate(M.SIZES))
_HEAD, _TAIL = T.NO_VALID_PACKETS.split("{}")

ORACLE = {
    "capture_report": f"""with {_HEARD}, {duck('device_registry', 'alert_events', 'rules_text')},
feats as ({_FEATURES}),
vecs as (select capture_id, device_mac, windowid, [{', '.join(FT.FEATURES)}] as x0 from feats), {_NET},
scored as (select capture_id, device_mac, windowid, pow(list_distance(x8, x0), 2) / 45 as score from n7 where device_mac <> '{WITHOUT_MODEL}'),
framed as (select *, row_number() over (partition by device_mac order by windowid) as row_number, avg(score) over f as mean,
  sum((score > {THRESHOLD}::double)::int) over f as above from scored
  window f as (partition by device_mac order by windowid rows between 15 preceding and current row)),
counts as (select v.capture_id, v.device_mac, count(*) filter (f.row_number >= 16 and f.score > {THRESHOLD}::double and f.above >= 4
   and ((f.mean > {THRESHOLD}::double and f.above >= 5.44::double) or f.above >= 8)) as n, {PROGRESS.replace('device_mac', 'v.device_mac')} as progress,
  ('0x' || md5(v.device_mac)[1:8])::bigint / 4294967296::double as u
 from vecs v left join framed f on f.capture_id = v.capture_id and f.device_mac = v.device_mac and f.windowid = v.windowid group by 1, 2),
kinds as (select *, case when progress < 1 then 'other' when device_mac = '{WITHOUT_MODEL}' then 'error' when n > 0 then 'found' else 'clean' end as kind from counts),
verdicts as (select capture_id, device_mac, case when kind = 'found' then 'Alert' else 'Normal' end as type,
 case kind when 'error' then 'Error occured' when 'found' then n || ' Anomalies detected' when 'clean' then 'No Anomalies detected' else '' end as description,
 round(case kind when 'found' then {RP.ALERT_RANGE[0]} + u * {RP.ALERT_RANGE[1] - RP.ALERT_RANGE[0]} when 'clean' then u * {RP.NORMAL_RANGE[1]}::double else 0 end, 2) as score from kinds),
alerts as (select {CAPTURE_OF_ALERT} as capture_id, signature, (select arg_min(r.device_mac, r.position) from device_registry r
  where replace(r.device_mac, '-', ':') in (a.src_mac, a.dest_mac)) as device_mac
 from alert_events a where event_type = 'alert' and has_ether),
rolled as (select capture_id, device_mac, count(distinct signature) as signatures, count(*) as alerts from alerts group by 1, 2),
known as (select * from packets where device_mac in (select device_mac from device_registry)),
sizes as (select capture_id, device_mac, count(*) as packets, sum(packet_length)::bigint as bytes from known group by 1, 2),
totals as (select capture_id, sum(packets)::bigint as all_packets, sum(bytes)::bigint as total_bytes from sizes group by 1),
captures as (select distinct capture_id from heard union all select max(capture_id) + 1 from heard),
heads as (select c.capture_id, c.capture_id = (select max(capture_id) from captures) as broken, coalesce(all_packets, 0) as all_packets, coalesce(total_bytes, 0) as total_bytes
 from captures c left join totals t on t.capture_id = c.capture_id),
states as (select *, case when broken then 'truncated record header' when all_packets > 0 then null else '{T.NO_PACKETS}' end as model_error from heads)
select s.capture_id, case when model_error is null then 'success' else 'error' end as status,
 case when model_error is null then '' else '{{"rb":"' || case when broken then 'engine failed' else '' end || '","ml":"' || model_error || '"}}' end as message,
 upper(replace(d.device_mac, '-', ':')) as mac,
 case when model_error is null then coalesce(r.signatures, 0) end as signatures, case when model_error is null then coalesce(r.alerts, 0) end as alerts,
 case when model_error is null then coalesce(v.type, 'Normal') end as ml_type, case when model_error is null then coalesce(v.description, 'No data') end as ml_description,
 case when model_error is null then coalesce(v.score, 0)::double end as ml_score, case when model_error is null then coalesce(z.packets, 0) end as packets,
 case when model_error is null then total_bytes end as total_bytes, case when model_error is null then all_packets end as all_packets,
 case when model_error is null then (select count(*) from rules_text where line not like '#%') end as rules
from states s left join device_registry d on model_error is null
 left join verdicts v on v.capture_id = s.capture_id and v.device_mac = d.device_mac
 left join rolled r on r.capture_id = s.capture_id and r.device_mac = d.device_mac
 left join sizes z on z.capture_id = s.capture_id and z.device_mac = d.device_mac""",
}
