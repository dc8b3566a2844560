"""Registered queries over score series, densities and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as SC, thresholds as TH
from .fixtures import duck, view

FIXED_THRESHOLD = 0.1


def _scores(spark, sf):
    return view(spark, sf, "scores")


def _r(name, out=None):
    return F.round(F.col(name), 6).alias(out or name)


def _threshold(df):
    return df.select("device_mac", _r("threshold"))


def score_profile(spark, sf):
    names = ["min", "max", "mean", "std", "std_sample", "p25", "median", "p75", "p90", "p95", "p99", "p999", "rank90", "rank60", "mad"]
    return TH.profile(_scores(spark, sf)).select(
        "device_mac", "n", *[_r(c, f"s_{c}") for c in names], "above_p95", "above_p99"
    )


def trim_scores(spark, sf):
    return TH.trimmed(_scores(spark, sf)).select("device_mac", _r("score"), F.col("n").cast("long").alias("n")).groupBy(
        "device_mac", "score"
    ).agg(F.sum("n").alias("n"))


def outlier_subset(spark, sf):
    return TH.outlier_subset(_scores(spark, sf)).select("device_mac", _r("score"), "n").groupBy("device_mac", "score").agg(
        F.sum("n").alias("n")
    )


def score_density(spark, sf):
    return TH.kernel_density(_scores(spark, sf), TH.REGION_BANDWIDTH, reach=TH.REACH).select(
        "device_mac", F.col("pos").cast("long").alias("pos"), F.round("pdf", 4).alias("pdf")
    )


def hdr_threshold(spark, sf):
    return _threshold(TH.region_threshold(_scores(spark, sf)))


def valley_threshold(spark, sf):
    return _threshold(TH.valley_threshold(_scores(spark, sf)))


def connected_threshold(spark, sf):
    return _threshold(TH.connected_threshold(_scores(spark, sf)))


def gap_threshold(spark, sf):
    return _threshold(TH.gap_threshold(_scores(spark, sf)))


def tukey_threshold(spark, sf):
    return _threshold(TH.tukey_threshold(_scores(spark, sf)))


def needle_override(spark, sf):
    stats = TH.profile(_scores(spark, sf)).withColumn("base", F.col("p99") * 1.1)
    return TH.needle_override(stats).select("device_mac", _r("base"), _r("override"))


def slow_increment(spark, sf):
    scores = TH.prepare(_scores(spark, sf))
    start = scores.ranks.groupBy("device_mac").agg(TH.OS.quantile("score", 0.9).alias("start"))
    small = TH.slow_increment(scores, start, 1.1).select("device_mac", _r("raised", "raised_11"))
    large = TH.slow_increment(scores, start, 1.2).select("device_mac", _r("raised", "raised_12"))
    return small.join(large, "device_mac")


def final_threshold(spark, sf):
    return _threshold(TH.final_threshold(_scores(spark, sf)))


def _flagged(spark, sf):
    return SC.anomaly_flags(_scores(spark, sf).withColumn("threshold", F.lit(FIXED_THRESHOLD)))


def anomaly_flags(spark, sf):
    return _flagged(spark, sf).select("device_mac", "score_seq", F.col("is_anomaly").cast("long").alias("is_anomaly"))


def anomaly_counts(spark, sf):
    return SC.anomaly_counts(_flagged(spark, sf))


def score_tail(spark, sf):
    return SC.score_tail(_scores(spark, sf)).select("device_mac", "score_seq", _r("score"))


def score_history(spark, sf):
    scores = _scores(spark, sf)
    old, new = scores.filter("score_seq % 2 = 0"), scores.filter("score_seq % 2 = 1")
    return SC.score_history(old.withColumn("is_new", F.lit(0).cast("long")), new.withColumn("is_new", F.lit(1).cast("long"))).select(
        "device_mac", "score_seq", _r("score"), "is_new"
    )


def rolling_score_stats(spark, sf):
    return SC.rolling_stats(_scores(spark, sf)).select(
        "device_mac", "score_seq", F.round("rolling_mean", 9).alias("rolling_mean"), F.round("rolling_std", 9).alias("rolling_std")
    )


QUERIES = {
    f.__name__: f
    for f in (
        score_profile, trim_scores, outlier_subset, score_density, hdr_threshold, valley_threshold, connected_threshold,
        gap_threshold, tukey_threshold, needle_override, slow_increment, final_threshold, anomaly_flags, anomaly_counts,
        score_tail, score_history, rolling_score_stats,
    )
}

# --- DuckDB twins -----------------------------------------------------------

_S = duck("scores")

_PROFILE = """prof as (select device_mac, count(*) as n, min(score) as s_min, max(score) as s_max, avg(score) as s_mean,
 stddev_pop(score) as s_std, stddev_samp(score) as s_std_sample, quantile_cont(score, 0.25) as s_p25,
 median(score) as s_median, quantile_cont(score, 0.75) as s_p75, quantile_cont(score, 0.9) as s_p90,
 quantile_cont(score, 0.95) as s_p95, quantile_cont(score, 0.99) as s_p99, quantile_cont(score, 0.999) as s_p999,
 list_sort(list(score)) as s, mad(score) as s_mad from scores group by 1),
stats as (select *, s[floor(n * 0.9::double)::int + 1] as s_rank90, s[floor(n * 0.6::double)::int + 1] as s_rank60,
 len(list_filter(s, lambda x: x > s_p95)) as above_p95, len(list_filter(s, lambda x: x > s_p99)) as above_p99 from prof)"""

_TRIM = """lists as (select device_mac, list_sort(list(score)) as s, count(*) as n from scores group by 1),
trimming(device_mac, len, removed) as (
 select device_mac, ceil(n * 0.99::double)::bigint, 0::bigint from lists
 union all
 select t.device_mac, t.len - 1, t.removed + 1 from trimming t join lists l on t.device_mac = l.device_mac
 where l.s[t.len] > l.s[t.len - 1] * 1.1::double and t.removed < greatest(1, floor(l.n * 0.01::double))),
kept as (select device_mac, min(len) as len from trimming group by 1),
clean as (select k.device_mac, k.len as m, unnest(l.s[1:k.len]) as score, unnest(generate_series(1, k.len)) as i
 from kept k join lists l on k.device_mac = l.device_mac)"""

_GAP = """gaps as (select *, lead(score) over (partition by device_mac order by i) - score as gap from clean),
rated as (select *, (gap / greatest(score, 1e-12::double)) / pow(1 - i / m + 1e-12::double, 0.7::double) as rate
 from gaps where gap is not null and i / m >= 0.97::double),
best as (select * from (select *, row_number() over (partition by device_mac order by rate desc, i) as rn from rated) where rn = 1),
lefts as (select b.device_mac, median(c.score) as med, mad(c.score) as mad from best b join clean c
 on c.device_mac = b.device_mac and c.i <= b.i group by 1),
caps as (select device_mac, quantile_cont(score, 0.999) as cap from clean group by 1),
t4 as (select b.device_mac, least(greatest(least(base + least(3 * (mad + 1e-12::double), base * 0.1::double), cap), 0), 1) as threshold
 from (select *, score + 0.7::double * gap as base from best) b join lefts l on b.device_mac = l.device_mac
 join caps c on b.device_mac = c.device_mac)"""


def _kde(name: str, factor: float, size: int, observed: bool) -> str:
    lo, hi = ("mn", "mx") if observed else ("0::double", "1::double")
    return f"""{name}_p as (select device_mac, count(*) as n, {lo} as lo, ({hi} - {lo}) / {size - 1}::double as step,
  pow(count(*) * 0.75::double, -0.2::double) * sd * {factor}::double as h from
  (select *, min(score) over d as mn, max(score) over d as mx, stddev_samp(score) over d as sd from scores
   window d as (partition by device_mac)) group by device_mac, mn, mx, sd),
 {name}_u as (select device_mac, score, count(*) as c from scores group by 1, 2),
 {name} as (select p.device_mac, g.pos, p.lo + g.pos * p.step as x,
  sum(u.c * exp(-0.5::double * pow((p.lo + g.pos * p.step - u.score) / p.h, 2))) / max(p.n * p.h * sqrt(2 * pi())) as pdf
  from {name}_p p join {name}_u u on p.device_mac = u.device_mac cross join range({size}) g(pos) group by p.device_mac, g.pos, p.lo, p.step)"""


_T1 = _kde("k1", 0.9, 4096, False) + """,
 m1 as (select *, pdf / sum(pdf) over (partition by device_mac) as mass from k1),
 c1 as (select *, sum(mass) over (partition by device_mac order by pdf desc, pos rows unbounded preceding) as cum from m1),
 l1 as (select device_mac, max(pdf) filter (cum >= 0.99::double) as lam from c1 group by 1),
 i1 as (select c.device_mac, c.pos, c.mass, c.pos - row_number() over (partition by c.device_mac order by c.pos) as run
  from c1 c join l1 on c.device_mac = l1.device_mac where c.pdf >= l1.lam),
 r1 as (select device_mac, run, sum(mass) as mass, max(pos) as edge from i1 group by 1, 2),
 t1 as (select device_mac, coalesce(max(edge) filter (mass >= 0.05::double), arg_max(edge, mass)) / 4095::double as threshold from r1 group by 1)"""

_T2 = _kde("k2", 1.0, 2048, True) + """,
 d2 as materialized (select d.device_mac, d.score, (d.score - p.lo) / p.step as place, least(floor((d.score - p.lo) / p.step), 2046)::bigint as j
  from (select distinct device_mac, score from scores) d join k2_p p on d.device_mac = p.device_mac),
 p2 as materialized (select device_mac, pos, pdf as f0, lead(pdf) over (partition by device_mac order by pos) as f1 from k2),
 f2 as (select d2.device_mac, d2.score, greatest(f0 + (f1 - f0) * (place - j), 1e-300::double) as f
  from d2 join p2 on p2.device_mac = d2.device_mac and p2.pos = d2.j),
 n2 as (select *, lead(score) over w as nx, ln(f) - ln(lead(f) over w) as fall from f2 window w as (partition by device_mac order by score)),
 t2 as (select device_mac, least(greatest((score + nx) / 2, 0), 1) as threshold from
  (select *, row_number() over (partition by device_mac order by fall desc, score) as rn from n2 where nx is not null) where rn = 1)"""

_T3 = _kde("k3", 1.0, 4096, False) + """,
 w3 as (select *, max(pos) over w as hi, min(pos) over w as lo_pos, count(*) over w as k from k3
  window w as (partition by device_mac order by pdf desc range unbounded preceding)),
 s3 as (select device_mac, max(pdf) filter (hi - lo_pos + 1 <> k) as split_at from w3 group by 1),
 t3 as (select w3.device_mac, coalesce(max(pos) filter (split_at is null or pdf > split_at), arg_max(pos, pdf)) / 4095::double as threshold
  from w3 join s3 on w3.device_mac = s3.device_mac group by 1)"""


def _increment(name: str, start: str, factor: float) -> str:
    """Literal iteration of the raising loop."""
    return f"""{name}_loop(device_mac, k, thr, go) as (
  select device_mac, 0, start, start > 0 from {start}
  union all
  select l.device_mac, l.k + 1, case when q.used > q.lim then l.thr * {factor}::double else l.thr end, q.used > q.lim
  from {name}_loop l join (select * from lists0) a on a.device_mac = l.device_mac,
   lateral (select len(list_filter(a.s, lambda x: x < l.thr * {factor}::double)) - len(list_filter(a.s, lambda x: x < l.thr)) as used,
    floor(len(a.s) * 0.005::double) as lim) q where l.go),
 {name} as (select device_mac, arg_max(thr, k) as raised from {name}_loop group by 1)"""


_LISTS0 = "lists0 as (select device_mac, list_sort(list(score)) as s from scores group by 1)"

_NEEDLE = """case when s_p95 > 50 * s_median and not (abs({b} - s_p90) < abs({b} - s_p99))
 then least(greatest(least(s_median + 6 * (s_mad + 1e-12::double), s_p90), s_p90 + 0.1::double * greatest(s_p95 - s_p90, 0)),
  s_p95 - 0.1::double * greatest(s_p95 - s_median, 1e-12::double)) else {b} end"""

_FINAL = f"""with recursive {_S}, {_PROFILE}, {_LISTS0}, {_T1}, {_T2}, {_T3}, {_TRIM}, {_GAP},
 based as (select stats.*, case when t1.threshold * 1.2::double not in (0, 1) then t1.threshold * 1.2::double
   when t2.threshold * 1.2::double not in (0, 1) then t2.threshold * 1.2::double
   when t3.threshold * 1.2::double not in (0, 1) then t3.threshold * 1.2::double
   when t4.threshold * 1.2::double not in (0, 1) then t4.threshold * 1.2::double
   else least((s_p90 + s_std) * 1.2::double, s_p99) end as base
  from stats left join t1 using (device_mac) left join t2 using (device_mac) left join t3 using (device_mac) left join t4 using (device_mac)),
 g1 as (select *, {_NEEDLE.format(b='base')} as x1, abs(s_median - s_p95) < s_std * 2 as dense from based),
 g2 as (select *, case when x1 <= s_p99 then x1 when dense then greatest(s_median + 2 * s_std, s_p95)
  when above_p95 / n < 0.01::double and above_p99 / n < 0.005::double then s_p95 else x1 end as x2 from g1),
 a1 as (select device_mac, case when 5 * abs(x2 - s_p95) > abs(x2 - s_median) then x2 else s_p95 end as start from g2 where x2 < s_p95),
 {_increment('inc1', 'a1', 1.1)},
 g3 as (select g2.*, case when x2 < s_p95 then inc1.raised else x2 end as x3 from g2 left join inc1 using (device_mac)),
 a2 as (select device_mac, x3 as start from g3),
 {_increment('inc2', 'a2', 1.2)},
 g4 as (select g3.*, case when not dense then x3 when abs(s_p95 - s_p99) < 2 * s_std and abs(s_max - s_p99) < s_std then s_max
  else inc2.raised end as x4 from g3 left join inc2 using (device_mac))
select device_mac, round(least(greatest(x4, greatest(s_p90, s_rank90)), s_max), 6) as threshold from g4"""

_ROUNDED = ["s_min", "s_max", "s_mean", "s_std", "s_std_sample", "s_p25", "s_median", "s_p75", "s_p90", "s_p95", "s_p99",
            "s_p999", "s_rank90", "s_rank60", "s_mad"]

_FLAGS = f"""flags as (select device_mac, score_seq, (row_number() over w >= 16 and score > {FIXED_THRESHOLD}::double and above >= 4
  and ((mean > {FIXED_THRESHOLD}::double and above >= 5.44::double) or above >= 8))::int::bigint as is_anomaly
 from (select *, avg(score) over f as mean, sum((score > {FIXED_THRESHOLD}::double)::int) over f as above from scores
  window f as (partition by device_mac order by score_seq rows between 15 preceding and current row))
 window w as (partition by device_mac order by score_seq))"""


def _pick(ctes: str, name: str) -> str:
    return f"with recursive {_S}, {ctes} select device_mac, round(threshold, 6) as threshold from {name}"


ORACLE = {
    "score_profile": f"""with {_S}, {_PROFILE} select device_mac, n, {', '.join(f'round({c}, 6) as {c}' for c in _ROUNDED)},
 above_p95::bigint as above_p95, above_p99::bigint as above_p99 from stats""",
    "trim_scores": f"""with recursive {_S}, {_TRIM}
select device_mac, round(score, 6) as score, count(*) as n from clean group by 1, 2""",
    "outlier_subset": f"""with {_S}, {_PROFILE}
select sc.device_mac, round(score, 6) as score, count(*) as n from scores sc join stats using (device_mac)
where score > s_rank60 group by 1, 2""",
    "score_density": f"""with {_S}, {_kde('k1', 0.9, 4096, False)}
select device_mac, pos::bigint as pos, round(pdf, 4) as pdf from k1""",
    "hdr_threshold": _pick(_T1, "t1"),
    "valley_threshold": _pick(_T2, "t2"),
    "connected_threshold": _pick(_T3, "t3"),
    "gap_threshold": _pick(f"{_TRIM}, {_GAP}", "t4"),
    "tukey_threshold": f"""with {_S}, {_PROFILE} select device_mac,
 round(least(greatest(greatest(least(s_p75 + 1.5::double * greatest(s_p75 - s_p25, 1e-12::double), s_p999), s_p75), 0), 1), 6) as threshold from stats""",
    "needle_override": f"""with {_S}, {_PROFILE}, b as (select *, s_p99 * 1.1::double as base from stats)
select device_mac, round(base, 6) as base, round({_NEEDLE.format(b='base')}, 6) as override from b""",
    "slow_increment": f"""with recursive {_S}, {_LISTS0}, st as (select device_mac, quantile_cont(score, 0.9) as start from scores group by 1),
 {_increment('i11', 'st', 1.1)}, {_increment('i12', 'st', 1.2)}
select device_mac, round(i11.raised, 6) as raised_11, round(i12.raised, 6) as raised_12 from i11 join i12 using (device_mac)""",
    "final_threshold": _FINAL,
    "anomaly_flags": f"with {_S}, {_FLAGS} select * from flags",
    "anomaly_counts": f"""with {_S}, {_FLAGS} select device_mac, count(*) as windows, sum(is_anomaly)::bigint as num_anomalies
from flags group by 1""",
    "score_tail": f"""with {_S} select device_mac, score_seq, round(score, 6) as score from
 (select *, row_number() over (partition by device_mac order by score_seq desc) as rn from scores) where rn <= 15""",
    "score_history": f"""with {_S} select device_mac, score_seq, round(score, 6) as score, (score_seq % 2)::bigint as is_new from scores""",
    "rolling_score_stats": f"""with {_S} select device_mac, score_seq, round(avg(score) over f, 9) as rolling_mean,
 round(stddev_pop(score) over f, 9) as rolling_std from scores
 window f as (partition by device_mac order by score_seq rows between 14 preceding and current row)""",
}
