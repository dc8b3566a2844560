"""Registered queries over sources, stores, captures, logs and models."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..functions import scalars as S
from ..operators import logs, models as M, packets as P
from ..session import shared_dir
from ..sources import captures as C, files, ranges, stores
from . import synthetic
from .fixtures import duck, table, view


def _r(name, out=None):
    return F.round(F.col(name), 6).alias(out or name)


def _scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def capture_admission(spark, sf):
    magics = [*C.MAGICS, C.NEXT_GENERATION, "FFD8FFE0"]
    magic = F.element_at(F.array(*[F.lit(m) for m in magics]), (F.col("event_id") % len(magics) + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", F.unhex(F.concat(magic, F.lit("00000000"))).alias("content"))
    return C.admission(rows).select(
        "event_id", "magic", *[F.col(c).cast("long").alias(c) for c in ("accepted", "readable")],
        "byte_order", "resolution", F.col("long_records").cast("long").alias("long_records"),
    )


def read_captures(spark, sf):
    frames = C.read_captures(synthetic.capture_files(view(spark, sf, "raw_frames")))
    return frames.select(
        "capture_id", "seq", "ts_us", F.length("frame").cast("long").alias("frame_len"),
        F.hex(F.substring("frame", 7, 6)).alias("src"),
    )


def capture_ranges(spark, sf):
    """The same frames from files on disk, each read by several tasks."""
    contents = synthetic.capture_files(view(spark, sf, "raw_frames"))
    root = _scratch(spark, "captures")
    ranges.write_files(contents.select(F.concat(F.col("capture_id").cast("string"), F.lit(".pcap")).alias("name"), "content"), root)
    frames = ranges.read_ranges(spark, root, range_bytes=100_000, max_frame=4096)
    capture = F.regexp_extract("path", r"(\d+)\.pcap$", 1).cast("long")
    place = F.row_number().over(Window.partitionBy("path").orderBy("seq")) - 1  # the number of a frame, for the comparison
    return frames.select(
        capture.alias("capture_id"), place.cast("long").alias("seq"), "ts_us", F.length("frame").cast("long").alias("frame_len"),
        F.hex(F.substring("frame", 7, 6)).alias("src"),
    )


def decode_frames(spark, sf):
    frames = P.decode_frames(synthetic.frames_of_packets(view(spark, sf, "packets")))
    fields = ["frame_len", "eth_type", "proto", "src_ip", "dst_ip", "src_port", "dst_port", "ip_ttl", "tcp_flags"]
    return frames.select("seq", "src_mac", "dst_mac", *[F.col(c).cast("long").alias(c) for c in fields])


def packets_from_captures(spark, sf):
    """Bytes to attributed packets: the whole first half of the pipeline."""
    frames = synthetic.frames_of_packets(view(spark, sf, "packets"))
    packets = P.packets_from_frames(frames, view(spark, sf, "device_registry"))
    return packets.select(
        "capture_id", "seq", "device_mac", "packet_length", F.col("is_outgoing").cast("long").alias("is_outgoing"),
        *[F.col(c).cast("long").alias(c) for c in ("remote_ip", "remote_port")],
    )


def device_registry(spark, sf):
    rows = view(spark, sf, "device_registry")
    # The registry document of a site lists its own devices only.
    document = rows.groupBy((F.col("position") % 2).alias("site")).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            F.translate(F.upper("device_mac"), "-", ":").alias("k"), F.lit("{}").alias("v")
        ))))).alias("value")
    )
    parsed = document.select("site", F.posexplode(F.map_keys(files.registry_from_json(F.col("value")))).alias("position", "mac"))
    return parsed.select("site", F.col("position").cast("long").alias("position"), S.mac_key(F.col("mac")).alias("device_mac"))


def read_alerts(spark, sf):
    rows = view(spark, sf, "alert_events")
    ether = F.when(F.col("has_ether"), F.struct("src_mac", "dest_mac"))
    stamp = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    lines = rows.select(
        "seq",
        F.to_json(F.struct("event_type", stamp.alias("timestamp"), F.struct("signature").alias("alert"), ether.alias("ether"))).alias("value"),
    )
    return files.parse_alerts(lines).select(
        "seq", "event_type", "ts_us", "signature", F.coalesce(F.array_join("macs", ","), F.lit("")).alias("macs")
    )


def telemetry_parse(spark, sf):
    parsed = logs.parse_telemetry(view(spark, sf, "telemetry_text"))
    value = F.try_variant_get("parsed", "$.sysstat.hosts[0].statistics[0].v", "long")
    return parsed.select("event_id", "state", value.alias("v"))


def telemetry_merge(spark, sf):
    """Three reports a host and hour; the newest of each counts."""
    rows = view(spark, sf, "telemetry_reports")
    merged = logs.merge_telemetry(rows, ["host", "hour"])
    path = {s: f"$.{s}.sysstat.hosts[0].statistics[0].v" for s in logs.TELEMETRY_SOURCES}
    document = F.parse_json("monitor")
    return merged.select(
        "host", "hour", *[f"{s}_state" for s in path],
        *[F.try_variant_get(document, p, "long").alias(f"{s}_v") for s, p in path.items()],
        *[F.try_variant_get(document, f"$.{s}[0]", "string").alias(f"{s}_raw") for s in path],
    )


def log_bundle(spark, sf):
    """One document for each site of ten files: the last five lines of every file, packed and read back."""
    tails = logs.log_tail(_doc_lines(spark, sf), 5).withColumn("site", F.floor(F.col("file") / 10))
    packed = logs.error_bundle(tails, ["site"], "v1").select("site", F.explode("error_logs").alias("version", "encoded"), "document")
    pages = F.from_json("document", "map<string,string>")
    return packed.select(
        "site", "version", F.explode(pages).alias("file", "text"),
        F.startswith("encoded", F.lit("H4sIAAAAAAA")).cast("long").alias("is_gzip"),  # its magic number, without a time
    )


def _doc_lines(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("long")
    )


def log_tail(spark, sf):
    return logs.bundle(logs.log_tail(_doc_lines(spark, sf), 5)).select(
        "file", "text", S.base64_text(F.col("text").cast("binary")).alias("encoded")
    )


def log_lines(spark, sf):
    return _doc_lines(spark, sf).select("file", "line_no", "line")


def artifact_digest(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("digest"), S.base64_text(F.col("text").cast("binary")).alias("encoded")
    )


def _vectors(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rows.select(
        F.concat(F.lit("aa-bb-cc-00-00-0"), (F.col("vec_id") % 8).cast("string")).alias("device_mac"),
        F.col("vec_id").alias("vec_seq"),
        F.transform(F.sequence(F.lit(0), F.lit(44)), lambda i: (
            F.get("embedding", i).cast("double") + F.coalesce(F.get("embedding", i + 45).cast("double"), F.lit(0.0))
        )).alias("vector"),  # all 64 values, folded to the 45 inputs of a model
    )


def feature_store_append(spark, sf):
    rows = _vectors(spark, sf)
    path = _scratch(spark, "features")
    stores.append_features(rows.filter("vec_seq % 2 = 0"), path)
    stores.append_features(rows.filter("vec_seq % 2 = 1"), path)
    wanted = rows.filter("device_mac <> 'aa-bb-cc-00-00-07'").select("device_mac")
    loaded = stores.load_features(spark, path, wanted)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return loaded.groupBy("device_mac").agg(F.count(F.lit(1)).alias("windows"), F.round(F.sum(total), 4).alias("total"))


def model_store(spark, sf):
    layers = M.layer_table(_vectors(spark, sf))
    path = _scratch(spark, "models")
    stores.save_models(M.flat_models(layers), path)
    loaded = stores.load_models(spark, path, M.PARAMETERS)
    total = F.aggregate("params", F.lit(0.0), lambda a, x: a + x)
    return loaded.select("device_mac", F.size("params").cast("long").alias("weights"), F.round(total, 4).alias("total"))


def _models(spark, sf):
    return M.flat_models(M.layer_table(_vectors(spark, sf)))


def score_windows(spark, sf):
    return M.score_windows(_vectors(spark, sf), _models(spark, sf)).select("device_mac", "vec_seq", _r("score"))


def score_windows_sql(spark, sf):
    vectors = _vectors(spark, sf)
    return M.score_windows_sql(vectors, M.layer_table(vectors)).select("device_mac", "vec_seq", _r("score"))


def report_sink(spark, sf):
    rows = view(spark, sf, "alert_events").filter("event_type = 'alert'")
    reports = rows.groupBy("src_mac").agg(F.count(F.lit(1)).alias("alerts"), F.max("ts_us").alias("newest"))
    path = _scratch(spark, "reports")
    stores.write_reports(reports, path)
    return spark.read.schema("src_mac string, alerts long, newest long").json(path)


QUERIES = {
    f.__name__: f
    for f in (
        capture_admission, read_captures, capture_ranges, decode_frames, packets_from_captures, device_registry, read_alerts,
        telemetry_parse, telemetry_merge, log_tail, log_bundle, log_lines, artifact_digest, feature_store_append, model_store, score_windows,
        score_windows_sql, report_sink,
    )
}

# --- DuckDB twins -----------------------------------------------------------

_VECTORS = """vecs as (select concat('aa-bb-cc-00-00-0', vec_id % 8) as device_mac, vec_id as vec_seq,
 list_transform(range(45), lambda i: embedding[i + 1]::double + coalesce(embedding[i + 46]::double, 0)) as x0 from embeddings)"""


def _layer(l: int, out: int, inp: int, relu: bool) -> str:
    w = f"list_transform(range({out}), lambda i: list_transform(range({inp}), lambda j: sin({l} + 2 * i + 3 * j) / sqrt({inp}::double)))"
    z = f"list_dot_product(w{l}[i + 1], x{l}) + cos({l} + i) / 10"
    z = f"greatest({z}, 0)" if relu else z
    return f"n{l} as (select *, list_transform(range({out}), lambda i: {z}) as x{l + 1} from (select *, {w} as w{l} from {'vecs' if l == 0 else f'n{l - 1}'}))"


_SCORES = f"""with {_VECTORS}, {', '.join(_layer(l, o, i, l not in M.LINEAR_LAST) for l, (o, i) in enumerate(M.SIZES))}
select device_mac, vec_seq, round(pow(list_distance(x8, x0), 2) / 45, 6) as score from n7"""

_WEIGHTS = " + ".join(
    f"(select sum(sin({l} + 2 * i + 3 * j) / sqrt({n}::double)) from range({o}) a(i), range({n}) b(j)) + (select sum(cos({l} + i) / 10) from range({o}) a(i))"
    for l, (o, n) in enumerate(M.SIZES)
)

_MAGIC_ROWS = ", ".join(
    f"({i}, '{m}', 1, {int(m in C.MAGICS)}, "
    + (f"'{C.MAGICS[m][0]}', '{C.MAGICS[m][1]}', {int(C.MAGICS[m][2])})" if m in C.MAGICS else "null, null, null)")
    for i, m in enumerate([*C.MAGICS, C.NEXT_GENERATION])
) + ", (7, 'FFD8FFE0', 0, 0, null, null, null)"

_DOC_LINES = """lines as (select doc_id as file, unnest(generate_series(0, len(parts) - 1)) as line_no, unnest(parts) as line
 from (select doc_id, string_split(text, chr(10)) as parts from documents))"""

_READ = f"""with {duck('raw_frames')}
select seq // 500 as capture_id, seq % 500 as seq, ts_us, frame_len,
 case when frame_len < 12 then upper(replace(src_mac, '-', ''))[1:2 * (frame_len - 6)] else upper(replace(src_mac, '-', '')) end as src
from raw_frames"""

ORACLE = {
    "capture_admission": f"""select event_id, magic, accepted::bigint as accepted, readable::bigint as readable, byte_order, resolution,
 long_records::bigint as long_records from events
 join (values {_MAGIC_ROWS}) as m(k, magic, accepted, readable, byte_order, resolution, long_records) on event_id % 8 = k""",
    "read_captures": _READ,
    "capture_ranges": _READ,
    "decode_frames": f"""with {duck('packets')}
select seq, case when is_outgoing then device_mac else '02-00-00-00-00-01' end as src_mac,
 case when is_outgoing then '02-00-00-00-00-01' else device_mac end as dst_mac, packet_length as frame_len, 2048::bigint as eth_type,
 proto::bigint as proto, (case when is_outgoing then device_ip else remote_ip end)::bigint as src_ip,
 (case when is_outgoing then remote_ip else device_ip end)::bigint as dst_ip,
 (case when is_outgoing then device_port else remote_port end)::bigint as src_port,
 (case when is_outgoing then remote_port else device_port end)::bigint as dst_port, ip_ttl::bigint as ip_ttl, tcp_flags::bigint as tcp_flags
from packets""",
    "packets_from_captures": f"""with {duck('packets', 'device_registry')}
select capture_id, seq, device_mac, packet_length, is_outgoing::bigint as is_outgoing, remote_ip::bigint as remote_ip,
 remote_port::bigint as remote_port from packets where device_mac in (select device_mac from device_registry)""",
    "device_registry": f"""with {duck('device_registry')}
select position % 2 as site, row_number() over (partition by position % 2 order by device_mac) - 1 as position, device_mac
from device_registry""",
    "read_alerts": f"""with {duck('alert_events')}
select seq, event_type, ts_us, signature, case when has_ether then src_mac || ',' || dest_mac else '' end as macs from alert_events""",
    "telemetry_parse": f"""with {duck('telemetry_text')}
select event_id, case when json_valid(body) then 'intact' when json_valid(body || ']}}]}}}}') then 'repaired' else 'raw' end as state,
 case when json_valid(body) then (body::json -> '$.sysstat.hosts[0].statistics[0].v')::bigint
  when json_valid(body || ']}}]}}}}') then ((body || ']}}]}}}}')::json -> '$.sysstat.hosts[0].statistics[0].v')::bigint end as v
from telemetry_text""",
    "telemetry_merge": f"""with {duck('telemetry_reports')}, newest as (
 select host, hour, source, arg_max(body, struct_pack(a := seq, b := body)) as body from telemetry_reports group by all),
parsed as (select *, case when body = '' then 'empty' when json_valid(body) then 'intact' when json_valid(body || ']}}]}}}}') then 'repaired'
  else 'raw' end as state, case when body = '' then null when json_valid(body) then body when json_valid(body || ']}}]}}}}') then body || ']}}]}}}}' end as doc
 from newest),
vals as (select *, (doc::json -> '$.sysstat.hosts[0].statistics[0].v')::bigint as v, case when state = 'raw' then body end as raw from parsed)
select host, hour, {', '.join(f"""coalesce(max(state) filter (source = '{s}'), 'missing') as {s}_state, max(v) filter (source = '{s}') as {s}_v,
 max(raw) filter (source = '{s}') as {s}_raw""" for s in logs.TELEMETRY_SOURCES)} from vals group by 1, 2""",
    "log_bundle": f"""with {_DOC_LINES}, last as (select *, row_number() over (partition by file order by line_no desc) as rn from lines)
select file // 10 as site, 'v1' as version, file::varchar as file, string_agg(line, chr(10) order by line_no) as text, 1::bigint as is_gzip
from last where rn <= 5 group by 1, 2, 3""",
    "log_tail": f"""with {_DOC_LINES}, last as (select *, row_number() over (partition by file order by line_no desc) as rn from lines),
texts as (select file, string_agg(line, chr(10) order by line_no) as text from last where rn <= 5 group by 1)
select file, text, base64(encode(text)) as encoded from texts""",
    "log_lines": f"with {_DOC_LINES} select file, line_no, line from lines",
    "artifact_digest": "select doc_id, sha256(text) as digest, base64(encode(text)) as encoded from documents",
    "feature_store_append": f"""with {_VECTORS} select device_mac, count(*) as windows, round(sum(list_sum(x0)), 4) as total
from vecs where device_mac <> 'aa-bb-cc-00-00-07' group by 1""",
    "model_store": f"""with {_VECTORS} select distinct device_mac, {M.PARAMETERS}::bigint as weights, round({_WEIGHTS}, 4) as total from vecs""",
    "score_windows": _SCORES,
    "score_windows_sql": _SCORES,
    "report_sink": f"""with {duck('alert_events')} select src_mac, count(*) as alerts, max(ts_us) as newest from alert_events
where event_type = 'alert' group by 1""",
}
