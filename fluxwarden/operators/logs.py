"""Log files and host telemetry."""

from __future__ import annotations

import base64
import gzip

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import ordered

TAIL_LINES = 5000
# Fixed value: closes a telemetry document that was cut off by an interrupt.
TELEMETRY_REPAIR = "]}]}}"
# The reports of the host monitor, in the order in which they are merged.
TELEMETRY_SOURCES = ("iostat", "pidstat", "sar")


def log_tail(lines: DataFrame, n: int = TAIL_LINES, bits: int = ordered.BLOCK_BITS) -> DataFrame:
    """The last ``n`` lines of each file from ``(file, line_no, line)``."""
    return ordered.latest(lines, ["file"], "line_no", n, bits)


def bundle(tails: DataFrame) -> DataFrame:
    """Tails as one text per file, at most ``n`` lines each."""
    return tails.groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text")
    )


def error_bundle(tails: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One document ``{file: text}`` for each key from ``(*keys, file, line_no, line)``: its JSON compressed, in base64,
    under the version's name.

    A document holds what ``log_tail`` left of each file, so its size follows from the number of files. A row without a
    file or line is left out; a key without any row has no document.
    """
    texts = tails.filter("file is not null and line is not null").groupBy(*keys, "file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text")
    )
    files = F.array_sort(F.collect_list(F.struct(F.col("file").cast("string").alias("file"), "text")))
    document = texts.groupBy(*keys).agg(F.to_json(F.map_from_entries(files)).alias("document"))
    # rows go to Python a hundred at a time; an Arrow batch would hold ten thousand documents of any size
    encoded = F.udf(_gzip, "string", useArrow=False)("document")
    return document.select(*keys, "document", F.create_map(F.lit(version), encoded).alias("error_logs"))


def _gzip(text: str) -> str:
    """Spark has no function that compresses a value; the time stamp of the header is 0, so equal logs give equal bytes."""
    return base64.b64encode(gzip.compress(text.encode(), mtime=0)).decode()


def numbered_lines(raw: DataFrame) -> DataFrame:
    """Number the lines of text files read in splits.

    ``raw``: ``file, split, id, line`` with ids rising inside a split. Splits are
    numbered on their own and shifted by the line counts of earlier splits.
    """
    counts = raw.groupBy("file", "split").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "split", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("file", "split").orderBy("id")
    return (
        raw.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, ["file", "split"])
        .select("file", (F.col("_offset") + F.col("_rn") - 1).alias("line_no"), "line")
    )


def parse_telemetry(texts: DataFrame) -> DataFrame:
    """Parse telemetry JSON, repairing documents that were cut off.

    ``parsed`` is null where even the repaired text is no JSON; the raw body
    stays available.
    """
    intact = F.try_parse_json("body")
    repaired = F.try_parse_json(F.concat("body", F.lit(TELEMETRY_REPAIR)))
    return texts.withColumns({"_intact": intact}).withColumns(
        {
            "parsed": F.coalesce("_intact", repaired),
            "state": F.when(F.col("_intact").isNotNull(), "intact")
            .when(repaired.isNotNull(), "repaired")
            .otherwise("raw"),
        }
    ).drop("_intact")


def merge_telemetry(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The monitor's reports of each key as one document, from ``(*keys, source, body)``.

    Each source is a member: its JSON, repaired where it was cut off, or the list of its raw lines where that fails; a
    source without a row, or of an empty or null body, is an empty object. Several bodies of one source are told apart by
    ``seq`` if there is such a column; the newest counts, ties by the greater text.
    """
    order = [F.col("seq")] if "seq" in texts.columns else []
    newest = texts.filter(F.col("source").isin(*TELEMETRY_SOURCES)).groupBy(*keys, "source").agg(
        F.max(F.struct(*order, F.coalesce("body", F.lit("")).alias("body")))["body"].alias("body")
    )
    parsed = parse_telemetry(newest)
    lines: Column = F.to_json(F.filter(F.split("body", "(?<=\n)"), lambda line: line != ""))
    member = F.when(F.trim("body") == "", F.lit("{}")).when(F.col("parsed").isNotNull(), F.to_json("parsed")).otherwise(lines)
    found = [
        F.coalesce(F.max(F.when(F.col("source") == s, F.col("_member"))), F.lit("{}")) for s in TELEMETRY_SOURCES
    ]
    states = [F.coalesce(F.max(F.when(F.col("source") == s, F.col("_state"))), F.lit("missing")).alias(f"{s}_state") for s in TELEMETRY_SOURCES]
    pairs = [F.concat(F.lit(f'"{s}":'), text) for s, text in zip(TELEMETRY_SOURCES, found)]
    state = F.when(F.trim("body") == "", "empty").otherwise(F.col("state"))
    return parsed.withColumns({"_member": member, "_state": state}).groupBy(*keys).agg(
        F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")).alias("monitor"), *states
    )
