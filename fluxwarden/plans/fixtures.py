"""Input views over the given tables, as SQL shared with the DuckDB checks.

Each view runs unchanged in Spark and DuckDB; only the microsecond expression
of ``events.ts`` differs. They read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Keyword that marks rules of the operator's own in the rule fixture.
OWN_ORIGIN = "homeguard"

BASE_US = 1704067200000000

# TIMESTAMP_NTZ to microseconds without any influence of the session time zone.
SPARK_US = (
    "(datediff(cast(ts as date), date'1970-01-01') * 86400000000L + hour(ts) * 3600000000L"
    " + minute(ts) * 60000000L + cast(extract(second from ts) * 1000000 as bigint))"
)
DUCK_US = "epoch_us(ts)"

VIEWS: dict[str, str] = {
    "packets": """
select cast(floor((({us}) - 1704067200000000) / 500 / 1728000000) as bigint) as capture_id,
 event_id as seq,
 cast(floor((({us}) - 1704067200000000) / 500) as bigint) + 1704067200000000 as ts_us,
 concat('aa-bb-cc-00-00-0', cast(user_id % 10 as string)) as device_mac,
 60 + cast(floor(value * 100) as bigint) % 1400 as packet_length,
 case when event_id % 3 = 0 then 17 else 6 end as proto,
 event_id % 2 = 0 as is_outgoing,
 3232235786 + user_id % 10 as device_ip,
 case event_id % 11 when 0 then 3758096635 when 1 then 4294967295
   when 2 then 3232235876 + user_id % 50 else 16777216 * (1 + user_id % 97) + event_id % 4 end as remote_ip,
 1024 + (user_id * 37) % 64000 as device_port,
 case event_type when 'click' then 443 when 'view' then 53 when 'error' then 123
   when 'purchase' then 1883 else 51000 end as remote_port,
 32 + (event_id * 7) % 224 as ip_ttl,
 case when event_id % 3 = 0 then null else (event_id * 13) % 256 end as tcp_flags
from events""",
    "raw_frames": """
select event_id as seq,
 cast(floor((({us}) - 1704067200000000) / 500 / 1728000000) as bigint) as capture_id,
 cast(floor((({us}) - 1704067200000000) / 500) as bigint) + 1704067200000000
   - case when event_id % 41 = 7 then 600000000 else 0 end as ts_us,
 case when event_id % 37 = 5 then 10 else 60 + cast(floor(value * 100) as bigint) % 1400 end as frame_len,
 case when event_id % 29 = 3 then 34525 else 2048 end as eth_type,
 case when event_id % 31 = 4 then 1 when event_id % 3 = 0 then 17 else 6 end as proto,
 case when event_id % 2 = 0 then concat('aa-bb-cc-00-00-0', cast(user_id % 10 as string))
   when event_id % 13 = 0 then concat('aa-bb-cc-00-00-0', cast((user_id + 1) % 10 as string))
   else 'aa-bb-cc-00-00-ff' end as src_mac,
 case when event_id % 2 = 1 then concat('aa-bb-cc-00-00-0', cast(user_id % 10 as string))
   when event_id % 13 = 0 then concat('aa-bb-cc-00-00-0', cast((user_id + 1) % 10 as string))
   else 'aa-bb-cc-00-00-ff' end as dst_mac
from events""",
    "device_registry": """
select distinct user_id % 10 as position, concat('aa-bb-cc-00-00-0', cast(user_id % 10 as string)) as device_mac
from events where user_id % 10 < 8""",
    "geo_ranges": """
select cast(16777216 as bigint) * (1 + 4 * n_nationkey) as ip_start,
 cast(16777216 as bigint) * (4 + 4 * n_nationkey) - 1 as ip_end,
 case when n_nationkey % 9 = 0 then '-' else n_name end as country
from nation""",
    "alert_events": """
select event_id as seq, {us} as ts_us,
 case when event_type = 'signup' then 'flow' else 'alert' end as event_type,
 concat('SIG ', cast(event_id % 5 as string)) as signature,
 event_id % 17 <> 0 as has_ether,
 concat('aa:bb:cc:00:00:0', cast(user_id % 10 as string)) as src_mac,
 concat('aa:bb:cc:00:00:0', cast((user_id + event_id) % 10 as string)) as dest_mac
from events where event_type in ('error', 'signup', 'purchase')""",
    "scores": """
select concat('aa-bb-cc-00-00-0', cast(user_id % 8 as string)) as device_mac, event_id as score_seq,
 case when user_id % 8 < 7 then value / 500.0e0 when event_id % 9 = 0 then 0.8e0 + value / 5000.0e0
   else value / 50000.0e0 end as score
from events""",
    "rules_text": """
select p_partkey as sid, concat(
 case when p_partkey % 11 = 0 then '# ' else '' end, 'alert ',
 case p_partkey % 4 when 0 then 'http' when 1 then 'dns' when 2 then 'tcp' else 'icmp' end,
 ' $HOME_NET any -> $EXTERNAL_NET any (msg:"',
 case p_partkey % 5 when 0 then 'HOMEGUARD' when 1 then 'URLhaus' when 2 then 'ET MALWARE' when 3 then 'ET INFO' else 'Local' end,
 ' sample ', cast(p_partkey as string), '"; content:"ther"; nocase; sid:', cast(p_partkey as string),
 '; rev:1; metadata:affected_product Linux, signature_severity ',
 case p_partkey % 3 when 0 then 'Major' when 1 then 'Informational' else 'Minor' end,
 ', confidence ', case p_partkey % 7 when 0 then 'Low' when 1 then 'Medium' else 'High' end, ';)') as line
from part""",
    "web_events": """
select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host,
 concat('GET ', regexp_extract(url, '^https?://[^/]+([^#]*)', 1), ' HTTP/1.1') as request_line
from pages""",
    "capture_runs": """
select o_orderkey as run_seq, o_custkey % 20 as site_id, o_orderstatus <> 'F' as ok from orders""",
    "telemetry_text": """
select event_id, concat('{{"sysstat":{{"hosts":[{{"statistics":[{{"v":', cast(user_id as string), '}}',
 case event_id % 3 when 0 then ']}}]}}}}' when 1 then '' else ',{{' end) as body
from events""",
    "telemetry_reports": """
select user_id % 5 as host, cast(floor(({us}) / 3600000000) as bigint) as hour, event_id as seq,
 case event_id % 4 when 0 then 'iostat' when 1 then 'pidstat' when 2 then 'sar' else 'other' end as source,
 case when event_id % 13 = 0 then '' else concat('{{"sysstat":{{"hosts":[{{"statistics":[{{"v":', cast(user_id as string), '}}',
 case event_id % 3 when 0 then ']}}]}}}}' when 1 then '' else ',{{' end) end as body
from events where event_id % 4 < 3""",
    "device_activity": """
select user_id % 40 as device_no, cast(floor(({us}) / 3600000000) as bigint) as hour_bucket,
 cast(floor(({us}) / 86400000000) as bigint) as day_bucket,
 count(*) * (1 + 40 * (max(user_id % 40) % 7)) as windows
from events where cast(floor(({us}) / 86400000000) as bigint) - 19723 <= (user_id % 40) % 6
 and (user_id % 40 not between 20 and 29 or event_id % 5 = 0)
group by 1, 2, 3""",
    "registry_state": """
select c_custkey as device_no,
 case c_custkey % 4 when 0 then 0.0e0 when 1 then 0.5e0 else 1.0e0 end as progress,
 case when c_custkey % 5 = 0 then 0 else c_custkey % 4400 end as current_size,
 case when c_custkey % 13 = 0 then null when c_custkey % 6 = 0 then 0.0001e0 else 0.02e0 end as threshold,
 case when c_custkey % 3 = 0 then '0.8' else '0.9' end as version,
 c_custkey % 17 <> 0 as has_model, c_custkey % 7 = 0 as model_equals_base,
 c_custkey % 19 <> 0 as has_dataset, c_custkey % 23 <> 0 as dataset_readable
from customer""",
}

# The table each view reads.
BASE_TABLE = {
    "geo_ranges": "nation",
    "rules_text": "part",
    "web_events": "pages",
    "capture_runs": "orders",
    "registry_state": "customer",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = BASE_TABLE.get(name, "events")
    source = f"fluxwarden_{base}"
    table(spark, sf_dir, base).createOrReplaceTempView(source)
    return spark.sql(VIEWS[name].format(us=SPARK_US).replace(f"from {base}", f"from {source}"))


def duck(*names: str) -> str:
    """The named views as DuckDB common table expressions."""
    return ",\n".join(f"{n} as ({VIEWS[n].format(us=DUCK_US)})" for n in names)
