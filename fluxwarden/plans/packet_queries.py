"""Registered queries over packets, frames, traffic and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import features as FT, geo, packets as P, traffic as TR, windows as W
from .fixtures import duck, view


def _packets(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "packets")


def _registered(spark: SparkSession, sf: str) -> DataFrame:
    known = view(spark, sf, "device_registry").select("device_mac")
    return _packets(spark, sf).join(known, "device_mac", "left_semi")


def _ends(spark: SparkSession, sf: str) -> DataFrame:
    return P.with_endpoints(_packets(spark, sf))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    frames = P.monotone_filter(view(spark, sf, "raw_frames"), ["capture_id"])
    return P.disposition(P.registry_flags(frames, view(spark, sf, "device_registry")))


def _long(name: str):
    return F.col(name).cast("long").alias(name)


def _r(c, name: str):
    return F.round(c, 6).alias(name)


def _flag(name: str):
    return F.col(name).cast("int").cast("long").alias(name)


def device_traffic(spark, sf):
    return TR.device_traffic(_packets(spark, sf), view(spark, sf, "device_registry"))


def device_direction(spark, sf):
    frames = P.registry_flags(view(spark, sf, "raw_frames"), view(spark, sf, "device_registry"))
    return P.assign_device(frames).filter("device_mac is not null").select("seq", "device_mac", _flag("is_outgoing"))


def locality_flags(spark, sf):
    rows = P.with_locality(_ends(spark, sf))
    return rows.select("seq", *[_flag(c) for c in ("is_multicast", "is_broadcast", "is_global")])


def mac_normalize(spark, sf):
    macs = view(spark, sf, "alert_events").select("seq", "src_mac")
    return macs.select(
        "seq",
        S.mac_key(F.col("src_mac")).alias("mac_key"),
        S.mac_display(S.mac_key(F.col("src_mac"))).alias("mac_display"),
        S.mac_from_bytes(F.unhex(F.translate("src_mac", ":", ""))).alias("from_bytes"),
    )


def ip_convert(spark, sf):
    rows = _packets(spark, sf).select("seq", "remote_ip", S.ip_text(F.col("remote_ip")).alias("ip_text"))
    packed = F.unhex(F.lpad(F.hex("remote_ip"), 8, "0"))
    return rows.select(
        "seq", "ip_text", S.ip_number(F.col("ip_text")).alias("ip_number"), S.unsigned(packed).alias("from_bytes")
    )


def payload_len(spark, sf):
    length = S.payload_length(F.col("packet_length"), F.col("proto") == 6)
    return _packets(spark, sf).select(
        "seq", length.alias("payload_len"), _r(S.log_cap(length, FT.PAYLOAD_CAP), "payload_len_scaled")
    )


def port_classes(spark, sf):
    rows = _ends(spark, sf)
    classes = {**S.port_classes(F.col("src_port"), "src"), **S.port_classes(F.col("dst_port"), "dst")}
    return rows.select("seq", *[c.cast("long").alias(n) for n, c in classes.items()])


def ttl_norm(spark, sf):
    return _packets(spark, sf).select("seq", _r(S.unit_scale(F.col("ip_ttl")), "ttl_norm"))


def log_cap_scale(spark, sf):
    return _packets(spark, sf).select(
        "seq",
        _r(S.log_cap(F.col("packet_length"), 1500.0), "scaled"),
        _r(S.log_cap(F.col("packet_length"), F.col("ip_ttl").cast("double") + 100, 1.0), "scaled_by_row"),
    )


def byte_balance(spark, sf):
    out = F.sum(F.when(F.col("is_outgoing"), F.col("packet_length")).otherwise(0))
    into = F.sum(F.when(F.col("is_outgoing"), 0).otherwise(F.col("packet_length")))
    return _packets(spark, sf).groupBy("capture_id", "device_mac").agg(_r(S.balance(out, into), "balance"))


def rates(spark, sf):
    span = (F.max("ts_us") - F.min("ts_us")) / F.lit(1e6)
    rows = _packets(spark, sf).groupBy("capture_id", "device_mac", "remote_ip")
    return rows.agg(
        _r(S.safe_div(F.count(F.lit(1)), span), "packets_per_second"),
        _r(S.safe_div(F.sum("packet_length"), span), "bytes_per_second"),
    )


def tcp_flags(spark, sf):
    flags = S.tcp_flag_columns(F.col("tcp_flags"), F.col("proto") == 6)
    return _packets(spark, sf).select("seq", *[c.cast("long").alias(n) for n, c in flags.items()])


def packet_disposition(spark, sf):
    return TR.disposition_counts(_labelled(spark, sf))


def monotone_filter(spark, sf):
    return P.monotone_filter(view(spark, sf, "raw_frames"), ["capture_id"]).select("seq", _flag("in_order"))


def enough_packets(spark, sf):
    return TR.enough_packets(_packets(spark, sf)).select("capture_id", "device_mac", "first_ts", "last_ts", "packets", _flag("enough"))


def capture_totals(spark, sf):
    frames = view(spark, sf, "raw_frames").select("capture_id")
    # the last two captures: one could not be read, one has no frame
    extra = frames.agg(F.max("capture_id").alias("last")).select(F.explode(F.array(F.col("last") + 1, F.col("last") + 2)).alias("capture_id"))
    failures = extra.groupBy().agg(F.min("capture_id").alias("capture_id")).withColumn("read_error", F.lit("truncated record header"))
    totals = TR.capture_totals(_labelled(spark, sf), frames.distinct().unionByName(extra), failures)
    return totals.select(
        "capture_id", _long("packets"), _long("total_bytes"), _long("faults"), _long("frames"),
        _r(F.col("fault_ratio"), "fault_ratio"), "error",
    )


def geo_lookup(spark, sf):
    ips = _packets(spark, sf).select("remote_ip").distinct()
    return geo.with_country(ips, _geo(spark, sf))


def _geo(spark, sf):
    ranges = view(spark, sf, "geo_ranges")
    return ranges.withColumn("country", F.when(F.col("country").contains("-"), geo.UNKNOWN).otherwise(F.col("country")))


def geo_ranges(spark, sf):
    return _geo(spark, sf)


def external_ip_traffic(spark, sf):
    return TR.external_ip_traffic(_registered(spark, sf), _geo(spark, sf))


def traffic_nested(spark, sf):
    nested = TR.nested_traffic(external_ip_traffic(spark, sf))
    stats = F.map_values("external_ips")
    total = F.aggregate(stats, F.lit(0).cast("long"), lambda a, s: a + s["data_volume_bytes"])
    known = F.size(F.filter(stats, lambda s: s["country"] != geo.UNKNOWN))
    return nested.select(
        "device_mac", F.size("external_ips").cast("long").alias("addresses"), total.alias("bytes"),
        known.cast("long").alias("located"),
    )


def flow_ids(spark, sf):
    return P.flow_ids(_packets(spark, sf)).select(
        "capture_id", *[_long(c) for c in P.FLOW_KEY], "first_seq", _long("flow_id"), "packets"
    )


def sliding_windows(spark, sf):
    return W.sliding_windows(_packets(spark, sf)).select("capture_id", "device_mac", "windowid", "seq")


def sliding_windows_partial(spark, sf):
    return W.sliding_windows(_packets(spark, sf), partial=True).select("capture_id", "device_mac", "windowid", "seq")


def flow_change(spark, sf):
    rows = W.window_row_changes(_packets(spark, sf))
    return rows.select(*W.WINDOW_KEYS, "seq", _long("flow_change"))


def inter_arrival(spark, sf):
    rows = W.window_row_changes(_packets(spark, sf))
    return rows.select(*W.WINDOW_KEYS, "seq", "iat_us", _r(F.col("iat_scaled"), "iat_scaled"))


def window_native(spark, sf):
    rows = FT.window_native(_packets(spark, sf))
    return rows.select(*W.WINDOW_KEYS, *[_r(F.col(c), c) for c in FT.FEATURES[:13]])


def window_distincts(spark, sf):
    return FT.window_distincts(_packets(spark, sf)).select(*W.WINDOW_KEYS, *[_long(c) for c in ("packets", "flows", "src_ips", "dst_ips", "connections")])


def window_features(spark, sf):
    rows = FT.window_features(_registered(spark, sf))
    return rows.select(*W.WINDOW_KEYS, *[_r(F.col(c), c) for c in FT.FEATURES])


QUERIES = {
    f.__name__: f
    for f in (
        device_traffic, device_direction, locality_flags, mac_normalize, ip_convert, payload_len, port_classes,
        ttl_norm, log_cap_scale, byte_balance, rates, tcp_flags, packet_disposition, monotone_filter, enough_packets,
        capture_totals, geo_ranges, geo_lookup, external_ip_traffic, traffic_nested, flow_ids, sliding_windows,
        sliding_windows_partial, flow_change, inter_arrival, window_native, window_distincts, window_features,
    )
}

# --- DuckDB twins -----------------------------------------------------------

_ENDS = """ends as (select *,
 case when is_outgoing then device_ip else remote_ip end as src_ip,
 case when is_outgoing then remote_ip else device_ip end as dst_ip,
 case when is_outgoing then device_port else remote_port end as src_port,
 case when is_outgoing then remote_port else device_port end as dst_port
 from packets)"""


def _ip(text: str) -> int:
    return S.ip_to_int(text)


_PRIVATE = " or ".join(
    f"remote_ip between {low} and {high}" for low, high in map(S.block_range, S.PRIVATE_BLOCKS)
)
_LOCAL = f"""local as (select *, is_multicast or is_broadcast as special from (select *,
 src_ip between {_ip('224.0.0.0')} and {_ip('239.255.255.255')} or dst_ip between {_ip('224.0.0.0')} and {_ip('239.255.255.255')} as is_multicast,
 src_ip = 4294967295 or dst_ip = 4294967295 as is_broadcast,
 ({_PRIVATE}) and remote_ip not in ({_ip('192.0.0.9')}, {_ip('192.0.0.10')}) as is_private from ends))"""

_LABELLED = """flagged as (select f.*,
  exists (select 1 from device_registry r where r.device_mac = f.src_mac) as src_known,
  exists (select 1 from device_registry r where r.device_mac = f.dst_mac) as dst_known,
  coalesce(ts_us >= max(case when frame_len >= 14 then ts_us end) over (partition by capture_id order by seq
    rows between unbounded preceding and 1 preceding), true) as in_order
 from raw_frames f),
labelled as (select *, case when frame_len < 14 then 'too_short' when not in_order then 'out_of_order'
  when eth_type <> 2048 then 'not_ipv4' when proto not in (6, 17) then 'not_tcp_udp'
  when not (src_known or dst_known) then 'unknown_device' else 'accepted' end as disposition from flagged)"""

_GEO = """geo as (select ip_start, ip_end, case when contains(country, '-') then 'Unknown' else country end as country
 from geo_ranges)"""
_COUNTRY = "coalesce((select max(g.country) from geo g where {ip} between g.ip_start and g.ip_end), 'Unknown')"

_WINDOWS = """bounds as (select capture_id, device_mac, min(ts_us) as first_ts, max(ts_us) as last_ts from {src} group by 1, 2),
wins as (select capture_id, device_mac, first_ts + 20000000 * k as windowid, first_ts + 20000000 * k + 60000000 as window_end
 from (select *, unnest(generate_series(0, (last_ts - first_ts) // 20000000)) as k from bounds) where {limit}),
exploded as (select p.*, w.windowid from {src} p join wins w on p.capture_id = w.capture_id and p.device_mac = w.device_mac
 and p.ts_us >= w.windowid and p.ts_us < w.window_end)"""
_COMPLETE = "first_ts + 20000000 * k + 60000000 <= last_ts"

_LAGGED = """flowed as (select *, concat_ws('/', proto, device_ip, remote_ip, device_port, remote_port) as flow,
  lag(concat_ws('/', proto, device_ip, remote_ip, device_port, remote_port)) over h as prev_flow,
  lag(ts_us) over h as prev_ts from exploded window h as (partition by device_mac order by capture_id, windowid, seq)),
changes as (select *, case when prev_flow is null or flow <> prev_flow then 1 else 0 end as flow_change,
  greatest(coalesce(ts_us - prev_ts, 0), 0) as iat_us from flowed)"""


def _win(src: str, limit: str = _COMPLETE) -> str:
    return _WINDOWS.format(src=src, limit=limit)


def _cap(x: str, cap: str) -> str:
    return f"ln(1 + least(greatest({x}, 0), {cap})::double) / ln(1 + ({cap})::double)"


def _spread(x: str) -> str:
    m = "(case when n = 1 then 2 else n end - 1)"
    return _cap(f"(case when n = 1 then 2 else {x} end - 1)", m)


_NATIVE = {
    "packet_count_scaled": _cap("n", "32"),
    "out_pkts_scaled": _cap("n_out", "32"),
    "in_pkts_scaled": _cap("n - n_out", "32"),
    "packets_per_second_scaled": _cap("case when secs = 0 then 0 else n / secs end", "10000"),
    "total_bytes_scaled": _cap("b", "1500"),
    "out_bytes_scaled": _cap("b_out", "1500"),
    "in_bytes_scaled": _cap("b - b_out", "1500"),
    "bytes_per_second_scaled": _cap("case when secs = 0 then 0 else b / secs end", "10000000"),
    "byte_balance05": "0.5 * (1 + tanh(ln(1 + b_out + 0.01::double) - ln(1 + b - b_out + 0.01::double)))",
    "flow_count_scaled": _spread("flows"),
    "src_ip_count_scaled": _spread("src_ips"),
    "dst_ip_count_scaled": _spread("dst_ips"),
    "connection_count_scaled": _spread("conns"),
}
_NATIVE_AGG = """count(*) as n, sum(is_outgoing::int) as n_out, sum(packet_length) as b,
 sum(case when is_outgoing then packet_length else 0 end) as b_out, (max(ts_us) - min(ts_us)) / 1e6::double as secs,
 count(distinct (proto, device_ip, remote_ip, device_port, remote_port)) as flows, count(distinct src_ip) as src_ips,
 count(distinct dst_ip) as dst_ips, count(distinct (least(src_ip, dst_ip), greatest(src_ip, dst_ip))) as conns"""

_MEASURES = """measured as (select *,
 ln(1 + least(iat_us, 3600000000)::double) / ln(1 + 3600000000::double) as iat_scaled,
 ln(1 + least(greatest(packet_length - case when proto = 6 then 54 else 42 end, 0), 65535)::double) / ln(65536::double) as payload_len_scaled,
 least(greatest(coalesce(ip_ttl, 0) / 255.0::double, 0), 1) as ip_ttl_norm,
 case when proto = 6 then coalesce(tcp_flags, 0) else 0 end as fl from changes)"""

_MEANS = {
    "flow_change_mean": "avg(flow_change)",
    **{
        f"{c}_{stat}": f"{fn}({c})"
        for c in ("iat_scaled", "payload_len_scaled", "ip_ttl_norm")
        for stat, fn in (("min", "min"), ("max", "max"), ("median", "median"), ("mean", "avg"))
    },
    **{
        f"{side}_port_{name}_mean": f"avg((({side}_port) {cond})::int)"
        for side in ("src", "dst")
        for name, cond in (("system", "<= 1023"), ("user", "between 1024 and 49151"), ("dynamic", ">= 49152"))
    },
    **{f"{name}_mean": f"avg(((fl & {bit}) <> 0)::int)" for name, bit in S.TCP_FLAG_BITS.items()},
    "is_outgoing_mean": "avg(is_outgoing::int)",
    "is_tcp_mean": "avg((proto = 6)::int)",
    "is_global_mean": "avg((not is_private and not special)::int)",
    "is_multicast_mean": "avg(is_multicast::int)",
    "is_broadcast_mean": "avg(is_broadcast::int)",
}

def features_sql(views: str, digits: int | None = 6) -> str:
    """The features of the packets of ``views``, a list of common table expressions with ``packets`` and ``device_registry``."""
    columns = [(_NATIVE.get(n, n), n) for n in FT.FEATURES]
    shown = ", ".join(f"round({e}, {digits}) as {n}" if digits else f"({e})::double as {n}" for e, n in columns)
    return f"""with {views}, {_ENDS}, {_LOCAL},
known as (select * from local where device_mac in (select device_mac from device_registry)),
usable as (select * from known where (capture_id, device_mac) in
 (select (capture_id, device_mac) from known group by capture_id, device_mac having max(ts_us) - min(ts_us) > 60000000)),
{_win('usable')}, {_LAGGED}, {_MEASURES},
agg as (select capture_id, device_mac, windowid, {_NATIVE_AGG}, {', '.join(f'{e} as {n}' for n, e in _MEANS.items())}
 from measured group by 1, 2, 3)
select capture_id, device_mac, windowid, {shown} from agg"""


ORACLE = {
    "device_traffic": f"""with {duck('packets', 'device_registry')}
select r.device_mac, count(p.seq) as packet_count, coalesce(sum(p.packet_length), 0)::bigint as data_volume_bytes
from device_registry r left join packets p on p.device_mac = r.device_mac group by 1""",
    "device_direction": f"""with {duck('raw_frames', 'device_registry')}, {_LABELLED}
select seq, case when src_known then src_mac else dst_mac end as device_mac, src_known::int::bigint as is_outgoing
from flagged where src_known or dst_known""",
    "locality_flags": f"""with {duck('packets')}, {_ENDS}, {_LOCAL}
select seq, is_multicast::int::bigint as is_multicast, is_broadcast::int::bigint as is_broadcast,
 (not is_private and not special)::int::bigint as is_global from local""",
    "mac_normalize": f"""with {duck('alert_events')}
select seq, replace(lower(src_mac), ':', '-') as mac_key, upper(src_mac) as mac_display,
 replace(lower(src_mac), ':', '-') as from_bytes from alert_events""",
    "ip_convert": f"""with {duck('packets')}
select seq, concat_ws('.', remote_ip // 16777216, remote_ip // 65536 % 256, remote_ip // 256 % 256, remote_ip % 256) as ip_text,
 remote_ip::bigint as ip_number, remote_ip::bigint as from_bytes from packets""",
    "payload_len": f"""with {duck('packets')}
select seq, payload_len, round({_cap('payload_len', '65535')}, 6) as payload_len_scaled
from (select seq, packet_length - case when proto = 6 then 54 else 42 end as payload_len from packets)""",
    "port_classes": f"""with {duck('packets')}, {_ENDS}
select seq, {', '.join(f"({s}_port {c})::int::bigint as {s}_port_{n}" for s in ('src', 'dst')
                       for n, c in (('system', '<= 1023'), ('user', 'between 1024 and 49151'), ('dynamic', '>= 49152')))} from ends""",
    "ttl_norm": f"with {duck('packets')} select seq, round(least(greatest(ip_ttl / 255.0::double, 0), 1), 6) as ttl_norm from packets",
    "log_cap_scale": f"""with {duck('packets')}
select seq, round({_cap('packet_length', '1500')}, 6) as scaled,
 round({_cap('packet_length - 1', '(ip_ttl + 99)')}, 6) as scaled_by_row from packets""",
    "byte_balance": f"""with {duck('packets')}, sums as (select capture_id, device_mac,
 sum(case when is_outgoing then packet_length else 0 end) as o, sum(case when is_outgoing then 0 else packet_length end) as i
 from packets group by 1, 2)
select capture_id, device_mac, round(0.5 * (1 + tanh(ln(1 + o + 0.01::double) - ln(1 + i + 0.01::double))), 6) as balance from sums""",
    "rates": f"""with {duck('packets')}, sums as (select capture_id, device_mac, remote_ip, count(*) as n, sum(packet_length) as b,
 (max(ts_us) - min(ts_us)) / 1e6::double as secs from packets group by 1, 2, 3)
select capture_id, device_mac, remote_ip, round(case when secs = 0 then 0 else n / secs end, 6) as packets_per_second,
 round(case when secs = 0 then 0 else b / secs end, 6) as bytes_per_second from sums""",
    "tcp_flags": f"""with {duck('packets')}
select seq, {', '.join(f"(proto = 6 and (coalesce(tcp_flags, 0) & {b}) <> 0)::int::bigint as {n}" for n, b in S.TCP_FLAG_BITS.items())}
from packets""",
    "packet_disposition": f"""with {duck('raw_frames', 'device_registry')}, {_LABELLED}
select capture_id, disposition, count(*) as frames from labelled group by 1, 2""",
    "monotone_filter": f"""with {duck('raw_frames', 'device_registry')}, {_LABELLED}
select seq, in_order::int::bigint as in_order from flagged""",
    "enough_packets": f"""with {duck('packets')}
select capture_id, device_mac, min(ts_us) as first_ts, max(ts_us) as last_ts, count(*) as packets,
 (max(ts_us) - min(ts_us) > 60000000)::int::bigint as enough from packets group by 1, 2""",
    "capture_totals": f"""with {duck('raw_frames', 'device_registry')}, {_LABELLED},
seen as (select capture_id, count(*) filter (disposition = 'accepted') as packets,
 coalesce(sum(frame_len) filter (disposition = 'accepted'), 0)::bigint as total_bytes,
 count(*) filter (disposition not in ('accepted', 'unknown_device')) as faults, count(*) as frames from labelled group by 1),
ends as (select max(capture_id) as last from seen),
t as (select *, null as read_error from seen union all
 select last + 1, 0, 0, 0, 0, 'truncated record header' from ends union all select last + 2, 0, 0, 0, 0, null from ends)
select * exclude (read_error), case when frames = 0 then 0 else round(faults / frames, 6) end as fault_ratio,
 case when read_error is not null then read_error when packets > 0 then null when faults > 0 then
 concat('{TR.NO_VALID_PACKETS.split("{}")[0]}', faults, '{TR.NO_VALID_PACKETS.split("{}")[1]}')
 else '{TR.NO_PACKETS}' end as error from t""",
    "geo_ranges": f"with {duck('geo_ranges')}, {_GEO} select * from geo",
    "geo_lookup": f"""with {duck('packets', 'geo_ranges')}, {_GEO}, ips as (select distinct remote_ip from packets)
select remote_ip, {_COUNTRY.format(ip='remote_ip')} as country from ips""",
    "external_ip_traffic": f"""with {duck('packets', 'geo_ranges', 'device_registry')}, {_GEO},
sums as (select device_mac, remote_ip, count(*) as packet_count, sum(packet_length)::bigint as data_volume_bytes from packets
 where device_mac in (select device_mac from device_registry) group by 1, 2)
select *, {_COUNTRY.format(ip='remote_ip')} as country from sums""",
    "traffic_nested": f"""with {duck('packets', 'geo_ranges', 'device_registry')}, {_GEO},
sums as (select device_mac, remote_ip, sum(packet_length) as b from packets
 where device_mac in (select device_mac from device_registry) group by 1, 2),
located as (select *, {_COUNTRY.format(ip='remote_ip')} as country from sums)
select device_mac, count(*) as addresses, sum(b)::bigint as bytes, count(*) filter (country <> 'Unknown') as located
from located group by 1""",
    "flow_ids": f"""with {duck('packets')}, flows as (select capture_id, proto, device_ip, remote_ip, device_port, remote_port,
 min(seq) as first_seq, count(*) as packets from packets group by all)
select capture_id, proto::bigint as proto, device_ip::bigint as device_ip, remote_ip::bigint as remote_ip,
 device_port::bigint as device_port, remote_port::bigint as remote_port, first_seq, packets,
 row_number() over (partition by capture_id order by first_seq) as flow_id from flows""",
    "sliding_windows": f"""with {duck('packets')}, {_win('packets')}
select capture_id, device_mac, windowid, seq from exploded""",
    "sliding_windows_partial": f"""with {duck('packets')}, {_win('packets', 'true')}
select capture_id, device_mac, windowid, seq from exploded""",
    "flow_change": f"""with {duck('packets')}, {_win('packets')}, {_LAGGED}
select capture_id, device_mac, windowid, seq, flow_change::bigint as flow_change from changes""",
    "inter_arrival": f"""with {duck('packets')}, {_win('packets')}, {_LAGGED}
select capture_id, device_mac, windowid, seq, iat_us::bigint as iat_us, round({_cap('iat_us', '3600000000')}, 6) as iat_scaled
from changes""",
    "window_native": f"""with {duck('packets')}, {_ENDS}, {_win('ends')},
agg as (select capture_id, device_mac, windowid, {_NATIVE_AGG} from exploded group by 1, 2, 3)
select capture_id, device_mac, windowid, {', '.join(f'round({e}, 6) as {n}' for n, e in _NATIVE.items())} from agg""",
    "window_distincts": f"""with {duck('packets')}, {_ENDS}, {_win('ends')}
select capture_id, device_mac, windowid, count(*) as packets,
 count(distinct (proto, device_ip, remote_ip, device_port, remote_port)) as flows, count(distinct src_ip) as src_ips,
 count(distinct dst_ip) as dst_ips, count(distinct (least(src_ip, dst_ip), greatest(src_ip, dst_ip))) as connections
from exploded group by 1, 2, 3""",
    "window_features": features_sql(duck("packets", "device_registry")),
}
