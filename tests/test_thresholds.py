"""Threshold search against plain NumPy loops on a small fixture."""

import numpy as np
import pytest

from fluxwarden.operators import scoring, thresholds as T
from fluxwarden.plans.fixtures import view
from fluxwarden.streaming.lookback import flag_scores


def series():
    rng = np.random.default_rng(11)
    return {
        "gamma": rng.gamma(1.2, 0.03, 300).clip(0, 1),
        "two": np.concatenate([rng.normal(0.1, 0.01, 200), rng.normal(0.5, 0.02, 100)]).clip(0, 1),
        "needle": np.concatenate([rng.gamma(1, 0.001, 267), rng.uniform(0.8, 0.81, 33)]),
        "steps": np.round(rng.gamma(2, 0.05, 250), 2).clip(0, 1),
        "tiny": rng.gamma(1, 1e-6, 120),
        "flat": np.full(60, 0.25),
    }


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(k, i, float(v)) for k, vs in series().items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "device_mac string, score_seq long, score double").repartition(5)


def density(s, lo, hi, size, factor):
    x = np.linspace(lo, hi, size)
    h = (len(s) * 0.75) ** -0.2 * s.std(ddof=1) * factor
    return x, np.exp(-0.5 * ((x[:, None] - s) / h) ** 2).sum(1) / (len(s) * h * np.sqrt(2 * np.pi))


def runs(mask):
    out, start = [], None
    for i, on in enumerate([*mask, False]):
        if on and start is None:
            start = i
        if not on and start is not None:
            out.append((start, i))
            start = None
    return out


def region(s):
    if s.std() == 0:
        return np.quantile(s, 0.99)
    x, f = density(s, 0, 1, 4096, 0.9)
    m = f / f.sum()
    order = np.argsort(-f, kind="stable")
    level = f[order[np.searchsorted(np.cumsum(m[order]), 0.99)]]
    pieces = [(m[a:b].sum(), x[b - 1]) for a, b in runs(f >= level)]
    kept = [edge for mass, edge in pieces if mass >= 0.05]
    return max(kept) if kept else max(pieces)[1]


def connected(s):
    if s.std() == 0:
        return 1.0
    x, f = density(s, 0, 1, 4096, 1.0)
    edge = None
    for level in np.unique(f)[::-1]:
        pieces = runs(f >= level)
        if len(pieces) != 1:
            break
        edge = x[pieces[0][1] - 1]
    return edge


def valley(s):
    v = np.unique(s)
    if len(v) == 1:
        return v[0]
    x, f = density(s, s.min(), s.max(), 2048, 1.0)
    at = np.log(np.maximum(np.interp(v, x, f), 1e-300))
    i = int(np.argmax(at[:-1] - at[1:]))
    return (v[i] + v[i + 1]) / 2


def trim(s):
    s = np.sort(s)
    n = len(s)
    s = s[: int(np.ceil(n * 0.99))]
    left = max(1, int(n * 0.01))
    while left and s[-1] > s[-2] * 1.1:
        s, left = s[:-1], left - 1
    return s


def gap(s):
    s = trim(s)
    n, g = len(s), np.diff(s)
    if not (g > 0).any():
        return s[-1]
    ids = [i for i in range(n - 1) if (i + 1) / n >= 0.97]
    rate = [g[i] / max(s[i], 1e-12) / (1 - (i + 1) / n + 1e-12) ** 0.7 for i in ids]
    i = ids[int(np.argmax(rate))]
    base, left = s[i] + 0.7 * g[i], s[: i + 1]
    mad = np.median(np.abs(left - np.median(left))) + 1e-12
    return float(np.clip(min(base + min(3 * mad, base * 0.1), np.percentile(s, 99.9)), 0, 1))


@pytest.mark.parametrize("ours, loop", [(T.region_threshold, region), (T.connected_threshold, connected), (T.valley_threshold, valley), (T.gap_threshold, gap)])
def test_strategy_equals_loop(scores, ours, loop):
    got = {r.device_mac: r.threshold for r in ours(scores).collect()}
    for name, s in series().items():
        assert got[name] == pytest.approx(loop(s), abs=1e-9), name


def test_trimmed(scores):
    got = {}
    for r in T.trimmed(scores).collect():
        got.setdefault(r.device_mac, []).extend([r.score] * r.n)
    for name, s in series().items():
        assert sorted(got[name]) == pytest.approx(list(trim(s)))


@pytest.mark.parametrize("factor", [1.1, 1.2])
def test_slow_increment_equals_iteration(spark, scores, factor):
    start = {k: float(np.quantile(v, 0.3)) for k, v in series().items()}
    df = spark.createDataFrame(list(start.items()), "device_mac string, start double")
    got = {r.device_mac: r.raised for r in T.slow_increment(scores, df, factor).collect()}
    for name, s in series().items():
        thr, limit = start[name], int(len(s) * 0.005)
        while ((s >= thr) & (s < thr * factor)).sum() > limit:
            thr *= factor
        assert got[name] == pytest.approx(thr), name


def test_final_threshold_stays_in_bounds_and_falls_back(scores):
    got = {r.device_mac: r.threshold for r in T.final_threshold(scores).collect()}
    assert set(got) == set(series())
    for name, s in series().items():
        assert max(np.quantile(s, 0.9), np.sort(s)[int(len(s) * 0.9)]) - 1e-12 <= got[name] <= s.max() + 1e-12, name


def test_stream_rule_equals_batch_rule(spark, scores):
    limited = scores.selectExpr("*", "case when device_mac = 'two' then 0.12 else 0.05 end as threshold")
    batch = {}
    for r in scoring.anomaly_flags(limited, bits=3).orderBy("score_seq").collect():
        batch.setdefault(r.device_mac, []).append(r.is_anomaly)
    assert any(map(any, batch.values()))
    for name, s in series().items():
        limit = 0.12 if name == "two" else 0.05
        tail, flags, at = np.array([]), [], 0
        for size in [3, 1, 20, 7, 40, 1000]:
            part = s[at : at + size]
            flags += list(flag_scores(tail, part, np.full(len(part), limit)))
            tail, at = np.concatenate([tail, part])[-15:], at + size
        assert flags == batch[name], name
        assert not any(flags[:15])


def test_truncated_kernels_stay_within_their_bound(spark):
    scores = view(spark, "/root/testdata/sf0.001", "scores")
    whole = {(r.device_mac, r.pos): r.pdf for r in T.kernel_density(scores, T.REGION_BANDWIDTH).collect()}
    near = {(r.device_mac, r.pos): r.pdf for r in T.kernel_density(scores, T.REGION_BANDWIDTH, reach=T.REACH).collect()}
    peaks = {}
    for (device, _), value in whole.items():
        peaks[device] = max(peaks.get(device, 0.0), value)
    assert set(whole) == set(near)
    assert all(abs(whole[k] - near[k]) <= 1e-11 * max(peaks[k[0]], 1.0) for k in whole)
