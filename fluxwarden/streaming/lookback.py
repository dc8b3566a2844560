"""Look-back rule over a stream of scores, with the last 15 scores as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.scoring import FRAME, HALF_ABOVE, LOOKBACK, MIN_ABOVE, SHARE_ABOVE

OUTPUT = "device_mac string, score_seq long, score double, threshold double, is_anomaly boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def flag_scores(history: np.ndarray, scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Flags of new scores, given the scores before them."""
    flags = np.zeros(len(scores), dtype=bool)
    series = np.concatenate([history, scores])
    if len(series) < FRAME:
        return flags
    frames = np.lib.stride_tricks.sliding_window_view(series, FRAME)
    # The k-th frame ends at series[k + 15]; keep the frames that end at a new score.
    first = max(len(history) - LOOKBACK, 0)
    frames = frames[first:]
    at = np.arange(first + LOOKBACK - len(history), len(scores))
    limit = thresholds[at]
    above = (frames > limit[:, None]).sum(axis=1)
    mean = frames.mean(axis=1)
    flags[at] = (
        (scores[at] > limit) & (above >= MIN_ABOVE)
        & (((mean > limit) & (above >= SHARE_ABOVE)) | (above >= HALF_ABOVE))
    )
    return flags


class LookbackProcessor(StatefulProcessor):
    """Carries the newest scores of a device from one micro-batch to the next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", "score double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("score_seq")  # one device within one trigger
        history = np.array([row[0] for row in self.tail.get()], dtype=float)
        scores = new["score"].to_numpy(float)
        flags = flag_scores(history, scores, new["threshold"].to_numpy(float))
        newest = np.concatenate([history, scores])[-LOOKBACK:]
        self.tail.put([(float(s),) for s in newest])
        yield pd.DataFrame(
            {
                "device_mac": key[0], "score_seq": new["score_seq"].to_numpy(), "score": scores,
                "threshold": new["threshold"].to_numpy(float), "is_anomaly": flags,
            }
        )

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def flag_stream(scores: DataFrame) -> DataFrame:
    """Streaming ``(device_mac, score_seq, score, threshold)`` to flagged rows."""
    return scores.groupBy("device_mac").transformWithStateInPandas(
        statefulProcessor=LookbackProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
