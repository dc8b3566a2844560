"""Status, thresholds, models and datasets of devices as one store that changes in one step.

Each table is a folder of Parquet parts, ``<root>/<table>/written_by=N/device_bucket=B``. A commit record, one small JSON
file ``<root>/commits/N.json``, names the parts that are alive in every table; all readers go by the newest record. A
change writes its parts first and then gives the next record its name, which the file system does in one step and refuses
where the name is taken. So

* a change of several tables is seen as a whole or not at all, whatever is lost between its writes;
* only the buckets of the devices concerned are written again, at most ``buckets`` folders a table;
* two writers cannot both follow the same record: the later one gets ``Conflict`` and starts over from the new state;
* a micro-batch that is repeated finds its number in the record and is left out.

Parts that no record names any more stay on disk until ``vacuum``, so a query that began before a change ends on the old
state. A record holds one path for each live part; ``put`` joins the parts of a bucket once they are more than ``MAX_PARTS``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructType

from ..session import cut_lineage
from .stores import FEATURE_BUCKETS, device_bucket

TABLES = ("status", "thresholds", "models", "datasets")
BUCKET, WRITER = "device_bucket", "written_by"  # folder names, not allowed as columns
MAX_PARTS = 16


class Conflict(Exception):
    """Another writer has committed since this change read its state."""


@dataclass
class State:
    """One commit: for each table its schema and the live parts of each bucket, and the last batch of each writer."""

    version: int = 0
    schemas: dict[str, dict] = field(default_factory=dict)
    parts: dict[str, dict[str, list[int]]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


@dataclass
class Change:
    """Rows to add to a table, after all rows of ``instead_of`` (a table of devices) have been taken out."""

    rows: DataFrame | None = None
    instead_of: DataFrame | None = None


def put(rows: DataFrame, key: str = "device_mac") -> Change:
    """The devices of ``rows`` get these rows instead of what they had."""
    rows = cut_lineage(rows)
    return Change(rows, rows.select(key).distinct())


def add(rows: DataFrame) -> Change:
    return Change(rows)


def remove(devices: DataFrame) -> Change:
    return Change(None, devices)


class ComponentStore:
    def __init__(self, spark: SparkSession, root: str, key: str = "device_mac", buckets: int = FEATURE_BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # --- files ---------------------------------------------------------------

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _children(self, *names: str) -> list[str]:
        folder, fs = self._path(*names), self._fs()
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def _text(self, *names: str) -> str:
        stream = self._fs().open(self._path(*names))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, state: State) -> None:
        """The record under its final name, in one step; refused where another record has it."""
        draft = self._path("commits", f".{uuid.uuid4().hex}")
        out = self._fs().create(draft, False)
        try:
            out.write(bytearray(json.dumps(state.__dict__).encode()))
        finally:
            out.close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        try:
            context.rename(draft, self._path("commits", f"{state.version:012d}.json"), plain)
        except Exception as error:
            self._fs().delete(draft, False)
            if "AlreadyExists" in str(error):
                raise Conflict(f"commit {state.version} of {self.root} exists") from error
            raise

    # --- reading ---------------------------------------------------------------

    def state(self, version: int | None = None) -> State:
        """The newest commit, or an earlier one."""
        done = [int(n.split(".")[0]) for n in self._children("commits") if n.endswith(".json") and not n.startswith(".")]
        done = [v for v in done if version is None or v <= version]
        return State(**json.loads(self._text("commits", f"{max(done):012d}.json"))) if done else State()

    def read(self, table: str, devices: DataFrame | None = None, state: State | None = None) -> DataFrame:
        """Rows of a table as of a commit, optionally of some devices; other buckets are then not listed or read. A table
        that has only been emptied so far has no rows and no column but the key."""
        state = state or self.state()
        if table not in state.schemas and table in state.parts:
            return self.spark.createDataFrame([], f"{self.key} string")
        if table not in state.schemas:
            raise KeyError(f"{table} has not been written to {self.root}")
        if devices is None:
            return self._rows(table, state, None).drop(BUCKET)
        wanted = devices.select(self.key).distinct()
        return self._rows(table, state, self._buckets_of(wanted)).drop(BUCKET).join(wanted, self.key, "left_semi")

    def _buckets_of(self, devices: DataFrame) -> set[str]:
        """At most ``buckets`` numbers."""
        rows = devices.select(device_bucket(self.key, self.buckets).alias(BUCKET)).distinct().collect()
        return {str(r[0]) for r in rows}

    def _rows(self, table: str, state: State, buckets: set[str] | None) -> DataFrame:
        schema = StructType.fromJson(state.schemas[table])
        paths = [
            f"{self.root}/{table}/{WRITER}={version:012d}/{BUCKET}={bucket}"
            for bucket, versions in sorted(state.parts[table].items()) if buckets is None or bucket in buckets
            for version in versions
        ]
        if not paths:
            return self.spark.createDataFrame([], schema.add(BUCKET, IntegerType()))
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)
        return rows.select(*schema.names, rows[BUCKET].cast("int").alias(BUCKET))

    # --- changing ---------------------------------------------------------------

    def commit(self, changes: dict[str, Change], base: State | None = None, writer: str = "", batch: int = -1) -> State:
        """Apply all changes in one step, on top of ``base`` (default: the newest commit), and return the new state.

        ``writer`` and ``batch`` name a micro-batch: one that the record already holds changes nothing.
        """
        base = base or self.state()
        if writer and base.batches.get(writer, -1) >= batch:
            return base
        after = State(
            base.version + 1, dict(base.schemas), {t: dict(p) for t, p in base.parts.items()},
            {**base.batches, **({writer: batch} if writer else {})},
        )
        for table, change in changes.items():
            self._write(table, change, base, after)
        self._publish(after)
        return after

    def _write(self, table: str, change: Change, base: State, after: State) -> None:
        rows = change.rows
        if rows is not None:
            plain = StructType.fromJson(json.loads(rows.schema.json()))
            for column in plain.fields:
                column.nullable = True
            if {BUCKET, WRITER} & set(plain.names):
                raise ValueError(f"{BUCKET} and {WRITER} are names of folders")
            known = base.schemas.get(table)
            if known and sorted(f.name for f in plain) != sorted(f["name"] for f in known["fields"]):
                raise ValueError(f"{table} holds {[f['name'] for f in known['fields']]}, not {plain.names}")
            after.schemas.setdefault(table, plain.jsonValue())
            rows = rows.select(*[f["name"] for f in after.schemas[table]["fields"]])
        parts = after.parts.setdefault(table, {})
        full = {b for b, v in parts.items() if len(v) >= MAX_PARTS} if rows is not None else set()
        replaced = self._buckets_of(change.instead_of) if change.instead_of is not None else set()
        rewritten = replaced | full
        written = rows.withColumn(BUCKET, device_bucket(self.key, self.buckets)) if rows is not None else None
        if rewritten & set(parts):
            kept = self._rows(table, base, rewritten)
            if change.instead_of is not None:
                kept = kept.join(change.instead_of.select(self.key).distinct(), self.key, "left_anti")
            written = kept if written is None else written.unionByName(kept)
        for bucket in rewritten:
            parts.pop(bucket, None)
        if written is None:
            return
        # A draft that a lost driver left under this number belongs to no record and is written over.
        target = f"{self.root}/{table}/{WRITER}={after.version:012d}"
        written.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(target)
        for name in self._children(table, f"{WRITER}={after.version:012d}"):
            if name.startswith(f"{BUCKET}="):
                parts.setdefault(name.split("=")[1], [])
                parts[name.split("=")[1]] = [*parts[name.split("=")[1]], after.version]

    def vacuum(self, keep: int = 1) -> int:
        """Delete parts that none of the newest ``keep`` commits names, and older records. Returns the parts deleted."""
        newest = self.state()
        held = [self.state(v) for v in range(max(newest.version - keep + 1, 1), newest.version + 1)]
        live = {(t, v, b) for s in held for t, p in s.parts.items() for b, vs in p.items() for v in vs}
        gone, fs = 0, self._fs()
        for table in newest.schemas:
            for folder in self._children(table):
                version = int(folder.split("=")[1])
                if version > newest.version:  # a change under way
                    continue
                for name in self._children(table, folder):
                    if name.startswith(f"{BUCKET}=") and (table, version, name.split("=")[1]) not in live:
                        gone += bool(fs.delete(self._path(table, folder, name), True))
        for name in self._children("commits"):
            if name.endswith(".json") and not name.startswith(".") and int(name.split(".")[0]) <= newest.version - keep:
                fs.delete(self._path("commits", name), False)
        return gone
