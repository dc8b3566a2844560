"""Reconstruction models: one small autoencoder per device.

A model is a flat array of its weights. Scoring and training stream over rows
that Spark has sorted by device, with the model row in front of its data, so no
device is ever held in memory as a whole and a busy device is scored by several
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import ordered
from .thresholds import outlier_subset

# Layer sizes and training settings.
LAYERS = [45, 64, 32, 16, 8, 16, 32, 64, 45]
BATCH = 16
EPOCHS = 3
LEARNING_RATE = 1e-4
CLIP_NORM = 1.0
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
LINEAR_LAST = {3, 7}  # latent and output layers have no ReLU

SIZES = [(LAYERS[i + 1], LAYERS[i]) for i in range(len(LAYERS) - 1)]
PARAMETERS = sum(o * i + o for o, i in SIZES)
MODEL_SCHEMA = (
    "device_mac string, params array<double>, moment1 array<double>, moment2 array<double>, steps long"
)


def wave_weights(layer: Column, i: Column, j: Column, fan_in: Column) -> Column:
    return F.sin(layer + 2 * i + 3 * j) / F.sqrt(fan_in)


def layer_table(devices: DataFrame) -> DataFrame:
    """Initial layers per device: ``(device_mac, layer, weights, bias)``."""
    shapes = F.array(*[F.struct(F.lit(l).alias("layer"), F.lit(o).alias("o"), F.lit(n).alias("n")) for l, (o, n) in enumerate(SIZES)])
    df = devices.select("device_mac").distinct().withColumn("_s", F.explode(shapes))
    s = F.col("_s")
    weights = F.transform(
        F.sequence(F.lit(0), s["o"] - 1),
        lambda i: F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda j: wave_weights(s["layer"], i, j, s["n"])),
    )
    bias = F.transform(F.sequence(F.lit(0), s["o"] - 1), lambda i: F.cos(s["layer"] + i) / 10)
    return df.select("device_mac", s["layer"].alias("layer"), weights.alias("weights"), bias.alias("bias"))


def flat_models(layers: DataFrame) -> DataFrame:
    """Layer rows to one model row per device; eight layers each."""
    flat = F.concat(F.flatten("weights"), F.col("bias"))
    rows = layers.groupBy("device_mac").agg(F.array_sort(F.collect_list(F.struct("layer", flat.alias("p")))).alias("_l"))
    empty = F.array().cast("array<double>")
    return rows.select(
        "device_mac", F.flatten(F.transform("_l", lambda x: x["p"])).alias("params"),
        empty.alias("moment1"), empty.alias("moment2"), F.lit(0).cast("long").alias("steps"),
    )


def split_layers(params: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for o, i in SIZES:
        out.append((params[at : at + o * i].reshape(o, i), params[at + o * i : at + o * i + o]))
        at += o * i + o
    return out


def forward(layers, x: np.ndarray) -> list[np.ndarray]:
    """Activations of all layers, the input first."""
    acts = [x]
    for index, (w, b) in enumerate(layers):
        z = acts[-1] @ w.T + b
        acts.append(z if index in LINEAR_LAST else np.maximum(z, 0.0))
    return acts


def reconstruction_error(layers, x: np.ndarray) -> np.ndarray:
    return ((forward(layers, x)[-1] - x) ** 2).mean(axis=1)


def gradients(layers, x: np.ndarray) -> np.ndarray:
    """Gradient of the mean squared reconstruction error, flattened."""
    acts = forward(layers, x)
    delta = 2.0 * (acts[-1] - x) / x.size
    parts = []
    for index in range(len(layers) - 1, -1, -1):
        if index not in LINEAR_LAST:
            delta = delta * (acts[index + 1] > 0)
        parts.append(np.concatenate([(delta.T @ acts[index]).ravel(), delta.sum(axis=0)]))
        delta = delta @ layers[index][0]
    return np.concatenate(parts[::-1])


class Adam:
    """Optimizer state of one device."""

    def __init__(self, params, moment1, moment2, steps):
        self.params = np.array(params, dtype=np.float64)
        self.m = np.array(moment1, dtype=np.float64) if len(moment1) else np.zeros_like(self.params)
        self.v = np.array(moment2, dtype=np.float64) if len(moment2) else np.zeros_like(self.params)
        self.steps = int(steps)

    def step(self, x: np.ndarray) -> None:
        g = gradients(split_layers(self.params), x)
        norm = np.sqrt((g * g).sum())
        g *= min(1.0, CLIP_NORM / (norm + 1e-6))
        self.steps += 1
        self.m = BETA1 * self.m + (1 - BETA1) * g
        self.v = BETA2 * self.v + (1 - BETA2) * g * g
        m_hat = self.m / (1 - BETA1**self.steps)
        v_hat = self.v / (1 - BETA2**self.steps)
        self.params = self.params - LEARNING_RATE * m_hat / (np.sqrt(v_hat) + EPSILON)


ROW_COLUMNS = ["device_mac", "_part", "_epoch", "vec_seq", "vector", "params", "moment1", "moment2", "steps"]


def _with_models(rows: DataFrame, models: DataFrame, partitions: int, tags: tuple[str, ...] = ()) -> DataFrame:
    """Data rows sorted behind the model row of their (device, part). ``tags`` are columns that travel with the rows."""
    null_array = F.lit(None).cast("array<double>")
    data = rows.select(
        "device_mac", "_part", "_epoch", "vec_seq", "vector",
        null_array.alias("params"), null_array.alias("moment1"), null_array.alias("moment2"), F.lit(0).cast("long").alias("steps"),
        *tags,
    )
    # A damaged model has no parameters: its device is scored like one without a model.
    usable = models.filter("params is not null")
    heads = rows.select("device_mac", "_part").distinct().join(usable, "device_mac").select(
        "device_mac", "_part", F.lit(-1).alias("_epoch"), F.lit(None).cast("long").alias("vec_seq"),
        null_array.alias("vector"), "params", "moment1", "moment2", "steps",
        *[F.lit(0).cast(rows.schema[t].dataType).alias(t) for t in tags],
    )
    return (
        heads.unionByName(data)
        .repartition(partitions, "device_mac", "_part")
        .sortWithinPartitions("device_mac", "_part", "_epoch", "vec_seq")
    )


def _partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _score_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    layers, owner = None, None
    for pdf in batches:
        heads = pdf["_epoch"].to_numpy() < 0
        devices = pdf["device_mac"].to_numpy()
        borders = heads.copy()
        borders[1:] |= devices[1:] != devices[:-1]
        borders[0] = True
        starts = np.flatnonzero(borders)
        for start, end in zip(starts, [*starts[1:], len(pdf)]):
            piece = pdf.iloc[start:end]
            if heads[start]:
                layers, owner = split_layers(np.asarray(piece["params"].iat[0], dtype=np.float64)), devices[start]
                piece = piece.iloc[1:]
            if not len(piece):
                continue
            # A device without a model gets no score.
            score = np.full(len(piece), np.nan)
            if devices[start] == owner:
                score = reconstruction_error(layers, np.stack(piece["vector"].to_numpy()).astype(np.float64))
            tagged = {c: piece[c] for c in pdf.columns if c not in ROW_COLUMNS}
            yield pd.DataFrame({"device_mac": piece["device_mac"], "vec_seq": piece["vec_seq"], "score": score, **tagged})


def score_windows(vectors: DataFrame, models: DataFrame, bits: int = ordered.BLOCK_BITS, tags: tuple[str, ...] = ()) -> DataFrame:
    """Reconstruction error of ``(device_mac, vec_seq, vector)`` rows; ``tags`` names further columns to keep."""
    rows = vectors.withColumns({"_part": F.shiftright("vec_seq", bits), "_epoch": F.lit(0)})
    schema = ["device_mac string, vec_seq long, score double", *(f"{t} {vectors.schema[t].dataType.simpleString()}" for t in tags)]
    return _with_models(rows, models, _partitions(vectors), tags).mapInPandas(_score_batches, ", ".join(schema))


def _train_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gradient steps in row order; a mini-batch ends with its epoch."""
    device, epoch, state, pending = None, None, None, []

    def finish():
        return pd.DataFrame(
            {"device_mac": [device], "params": [state.params], "moment1": [state.m], "moment2": [state.v], "steps": [state.steps]}
        )

    for pdf in batches:
        for row in pdf.itertuples(index=False, name=None):
            values = dict(zip(ROW_COLUMNS, row))
            if values["_epoch"] != epoch or values["device_mac"] != device:
                if pending:
                    state.step(np.stack(pending))
                    pending = []
                if values["device_mac"] != device and state is not None:
                    yield finish()
                device, epoch = values["device_mac"], values["_epoch"]
            if epoch < 0:
                state = Adam(values["params"], values["moment1"], values["moment2"], values["steps"])
                continue
            pending.append(np.asarray(values["vector"], dtype=np.float64))
            if len(pending) == BATCH:
                state.step(np.stack(pending))
                pending = []
    if state is not None:
        if pending:
            state.step(np.stack(pending))
        yield finish()


def _train(vectors: DataFrame, models: DataFrame, epochs: int) -> DataFrame:
    rows = vectors.withColumn("_part", F.lit(0).cast("long")).withColumn(
        "_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    )
    # Integer keys keep the sort order of the stream: model, then epochs in order.
    return _with_models(rows, models, _partitions(vectors)).select(*ROW_COLUMNS).mapInPandas(_train_batches, MODEL_SCHEMA)


def train_models(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """Fine-tune one model per device, then once more on its hardest rows.

    Gradient steps of a device follow each other, so a device is one task; its
    rows pass through in order and are never collected. The hardest rows are
    those scoring above rank floor(0.6 n), found by the distributed ranks.
    """
    from ..session import cut_lineage

    first = cut_lineage(_train(vectors, models, EPOCHS))
    scores = cut_lineage(score_windows(vectors, first))
    hard = scores.join(
        outlier_subset(scores).select("device_mac", "score").distinct(), ["device_mac", "score"], "left_semi"
    )
    again = vectors.join(hard.select("device_mac", "vec_seq"), ["device_mac", "vec_seq"], "left_semi")
    second = _train(again, first, 1)
    untouched = first.join(again.select("device_mac").distinct(), "device_mac", "left_anti")
    return second.unionByName(untouched)


# --- expression-only twin ---------------------------------------------------


def _dense(x: Column, layer: Column) -> Column:
    def unit(row: Column, i: Column) -> Column:
        products = F.zip_with(row, x, lambda a, b: a * b)
        z = F.aggregate(products, F.get(layer["bias"], i), lambda a, p: a + p)
        return F.greatest(z, layer["lowest"])

    return F.transform(layer["weights"], unit)


def score_windows_sql(vectors: DataFrame, layers: DataFrame, bits: int = ordered.BLOCK_BITS) -> DataFrame:
    """The same score from array expressions alone, for checks and small data.

    The vector is folded over the eight layers of its model; the lowest output
    of a layer is 0 with a ReLU and unbounded without.
    """
    lowest = F.when(F.col("layer").isin(sorted(LINEAR_LAST)), F.lit(float("-inf"))).otherwise(F.lit(0.0))
    stacked = layers.groupBy("device_mac").agg(
        F.array_sort(F.collect_list(F.struct("layer", lowest.alias("lowest"), "weights", "bias"))).alias("_layers")
    )
    rows = ordered.attach(ordered.with_block(vectors, "vec_seq", bits), stacked, ["device_mac"])
    output = F.aggregate("_layers", F.col("vector"), _dense)
    squares = F.zip_with(output, F.col("vector"), lambda a, b: (a - b) * (a - b))
    error = F.aggregate(squares, F.lit(0.0), lambda a, s: a + s) / F.lit(float(LAYERS[0]))
    return rows.select("device_mac", "vec_seq", error.alias("score"))
