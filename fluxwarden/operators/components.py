"""Changes of a device's components: reset, first start, refreshed thresholds, collected data, finished training.

Each function reads one state of a ``ComponentStore`` and commits one change on top of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from ..sources.components import Change, ComponentStore, State, add, put, remove
from . import training as TR
from .thresholds import final_threshold

STATUS = ["device_mac", "current_size", "distinct_hour_buckets", "distinct_day_buckets", "progress", "description"]


def _initial(devices: DataFrame, base_digest: str, base_params: list[float]) -> dict[str, Change]:
    fresh = TR.initial_components(devices.select("device_mac").distinct(), base_digest)
    params = F.lit(base_params).cast("array<double>") if base_params else F.array().cast("array<double>")
    return {
        "status": put(fresh.select(*STATUS)),
        "thresholds": put(fresh.select("device_mac", "threshold", "version")),
        "models": put(fresh.select("device_mac", "digest", params.alias("params"))),
        "datasets": remove(fresh.select("device_mac")),
    }


def reset(store: ComponentStore, devices: DataFrame, base_digest: str, base_params: list[float], base: State | None = None) -> State:
    """Base model, default threshold, empty status and no data for the devices, in one commit. No devices: no commit."""
    base = base or store.state()
    devices = cut_lineage(devices.select("device_mac").distinct())
    return store.commit(_initial(devices, base_digest, base_params), base) if not devices.isEmpty() else base


def audit(store: ComponentStore, base_digest: str, state: State | None = None) -> DataFrame:
    """First broken rule of each device that has a status; a device without data has no rows in the dataset."""
    state = state or store.state()
    sizes = store.read("datasets", state=state).select("device_mac").distinct().withColumn("readable", F.lit(True))
    status = store.read("status", state=state)
    # An emptied dataset is there, though it has no rows: only progress demands some.
    readable = status.select("device_mac", "current_size").join(sizes, "device_mac", "left").select(
        "device_mac", F.when(F.col("current_size") == 0, F.lit(True)).otherwise(F.col("readable")).alias("readable")
    )
    return TR.audit(
        status.select("device_mac", "progress", "current_size"), store.read("thresholds", state=state), store.read("models", state=state),
        readable, base_digest,
    )


def ensure(store: ComponentStore, registry: DataFrame, base_digest: str, base_params: list[float]) -> State:
    """Every device of the registry has consistent components: new devices, and known ones that the audit rejects, start
    from the beginning."""
    state = store.state()
    if "status" not in state.schemas:
        return reset(store, registry, base_digest, base_params, state)
    broken = audit(store, base_digest, state).filter("reason is not null").select("device_mac")
    fresh = TR.new_devices(registry, store.read("status", state=state), "device_mac")
    return reset(store, broken.unionByName(fresh), base_digest, base_params, state)


def refresh_thresholds(store: ComponentStore, training_scores: DataFrame, base_digest: str, base_params: list[float]) -> State:
    """Thresholds of an older rule: computed again from the scores of the training data where the device is trained,
    otherwise kept under the new version. A device without a threshold, without data, or whose computation gives none is
    reset. All in one commit."""
    state = store.state()
    data = store.read("datasets", state=state).select("device_mac").distinct()
    actions = cut_lineage(
        TR.stale_threshold_action(store.read("status", state=state), store.read("thresholds", state=state), data).select(
            "device_mac", "threshold", "threshold_action"
        )
    )
    stale = actions.filter("threshold_action = 'recompute'").select("device_mac")
    computed = final_threshold(training_scores.join(stale, "device_mac", "left_semi")).select("device_mac", "threshold")
    computed = cut_lineage(computed.filter("threshold is not null and not isnan(threshold)"))
    failed = stale.join(computed.select("device_mac"), "device_mac", "left_anti")
    lost = cut_lineage(actions.filter("threshold_action = 'reset'").select("device_mac").unionByName(failed))
    bumped = actions.filter("threshold_action = 'bump'").select("device_mac", "threshold")
    version = F.lit(TR.THRESHOLD_VERSION).alias("version")
    current = computed.unionByName(bumped).select("device_mac", "threshold", version)
    changes = _initial(lost, base_digest, base_params)
    changes["thresholds"] = put(current.unionByName(TR.initial_components(lost, base_digest).select("device_mac", "threshold", "version")))
    return store.commit(changes, state)


def collect(store: ComponentStore, features: DataFrame, activity: DataFrame, writer: str = "", batch: int = -1) -> State:
    """New feature rows and the status that follows from them, in one commit. ``activity``: windows of these rows by hour
    and day (``training.evaluate_status``). Devices that have no status are left out."""
    state = store.state()
    known = store.read("status", activity, state)
    grown = TR.merge_status(known, TR.evaluate_status(activity).join(known.select("device_mac"), "device_mac", "left_semi"))
    rows = features.join(known.select("device_mac"), "device_mac", "left_semi")
    return store.commit({"status": put(grown.select(*STATUS)), "datasets": add(rows)}, state, writer, batch)


def finish_training(store: ComponentStore, models: DataFrame, thresholds: DataFrame) -> State:
    """Trained models ``(device_mac, digest, params)`` with their thresholds; their devices' status becomes complete. A
    model without a threshold, or the other way round, changes nothing."""
    state = store.state()
    both = cut_lineage(models.join(thresholds.select("device_mac", "threshold"), "device_mac").filter("params is not null"))
    done = TR.complete_training(store.read("status", both, state))
    return store.commit(
        {
            "status": put(done.select(*STATUS)),
            "thresholds": put(both.select("device_mac", "threshold", F.lit(TR.THRESHOLD_VERSION).alias("version"))),
            "models": put(both.select("device_mac", "digest", "params")),
        },
        state,
    )
