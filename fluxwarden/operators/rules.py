"""Detection rules: selection, parsing and matching against events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import scalars as S
from ..session import cut_lineage

# Keyword patterns of the rule selection.
EXCLUDED = (
    "et info|affected_product windows|alert pkthdr|alert icmp|confidence low|confidence medium"
    "|signature_severity informational"
)
ORIGINS = "urlhaus|et malware"
SEVERE = "confidence high|signature_severity major"
ENABLED = r"^\s*alert"


def select_rules(lines: DataFrame, own_origin: str | None = None) -> DataFrame:
    """Rules of the known origins, and of ``own_origin``, a keyword that marks the operator's own rules."""
    line = F.col("line")
    origins = f"{own_origin}|{ORIGINS}" if own_origin else ORIGINS
    return lines.filter(
        ~line.rlike(f"(?i){EXCLUDED}") & line.rlike(f"(?i){origins}") & line.rlike(f"(?i){SEVERE}")
    )


def is_enabled(line: Column) -> Column:
    return line.rlike(ENABLED)


def rule_count(lines: DataFrame) -> DataFrame:
    return lines.agg(F.sum(F.when(is_enabled(F.col("line")), 1).otherwise(0)).cast("long").alias("enabled_rules"))


_SPEC = r"(!?\[[^\]]*\]|\S+)"  # an address or port, or a list
_HEADER = rf"^\s*#?\s*(\w+)\s+(\S+)\s+{_SPEC}\s+{_SPEC}\s+(->|<>)\s+{_SPEC}\s+{_SPEC}\s*\("
_OPTION = r'([A-Za-z_][A-Za-z0-9_.]*)(?::((?:"(?:[^"\\]|\\.)*"|[^";])*))?;'
CONTENT_TYPE = "array<struct<buffer:string,text:string,nocase:boolean,depth:int,negate:boolean>>"
# Fixed value: the option that ends the use of a buffer.
NO_BUFFER = "pkt_data"


def _names_buffer(o: Column) -> Column:
    """Options like ``http.uri`` without a value name the buffer that the following contents look into."""
    return F.contains(o["k"], F.lit(".")) & (F.coalesce(o["v"], F.lit("")) == "")


def decode_content(text: Column) -> Column:
    """Resolve ``|23 02|`` hexadecimal parts to one character per byte."""
    parts = F.split(text, r"\|", -1)
    return F.array_join(
        F.transform(
            parts,
            lambda part, i: F.when(i % 2 == 1, F.decode(F.unhex(F.translate(part, " ", "")), "ISO-8859-1")).otherwise(part),
        ),
        "",
    )


def parse_rules(lines: DataFrame) -> DataFrame:
    """Rule lines to columns, with contents as an array of structs and the
    metadata as a map. Lines are short and slow to parse, so the few splits of
    their files are dealt to more tasks first."""
    spark = lines.sparkSession
    lines = lines.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    line = F.col("line")
    names = ["action", "proto", "src", "src_port", "direction", "dst", "dst_port"]
    header = [F.regexp_extract(line, _HEADER, i + 1).alias(n) for i, n in enumerate(names)]
    body = F.regexp_extract(line, r"^[^(]*\((.*)\)\s*$", 1)
    keys = F.regexp_extract_all(body, F.lit(_OPTION), F.lit(1))
    values = F.regexp_extract_all(body, F.lit(_OPTION), F.lit(2))
    options = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda o: F.struct(
        o["k"].alias("k"), F.trim(F.regexp_replace(F.trim(o["v"]), r'^(!\s*)?"|"$', "")).alias("v"),
        F.trim(o["v"]).startswith("!").alias("negate"),  # outside the quotes
    ))
    df = lines.select("*", *header, options.alias("_options"))

    def option(name: str) -> Column:
        return F.try_element_at(F.filter("_options", lambda o: o["k"] == name), F.lit(1))["v"]

    df = df.withColumns(
        {
            "enabled": is_enabled(line),
            "msg": option("msg"),
            "rule_sid": option("sid").cast("long"),
            "rev": option("rev").cast("int"),
            "contents": _contents(),
            "metadata": F.transform_values(
                F.str_to_map(F.regexp_replace(F.coalesce(option("metadata"), F.lit("")), r",\s*", ","), F.lit(","), F.lit(" ")),
                lambda k, v: v,
            ),
        }
    )
    return df.drop("_options")


def _contents() -> Column:
    """Contents in order, each with the buffer named before it and the modifiers
    after it."""
    start = F.struct(F.lit("").alias("buffer"), F.array().cast(CONTENT_TYPE).alias("items"))

    def step(acc: Column, o: Column) -> Column:
        items, size = acc["items"], F.size(acc["items"])
        added = F.concat(
            items,
            F.array(F.struct(
                acc["buffer"].alias("buffer"), decode_content(o["v"]).alias("text"),
                F.lit(False).alias("nocase"), F.lit(None).cast("int").alias("depth"), o["negate"].alias("negate"),
            )).cast(CONTENT_TYPE),
        )

        def modified(nocase: Column, depth: Column) -> Column:
            return F.transform(items, lambda c, i: F.when(
                i == size - 1,
                F.struct(c["buffer"].alias("buffer"), c["text"].alias("text"),
                         (c["nocase"] | nocase).alias("nocase"), F.coalesce(depth, c["depth"]).alias("depth"), c["negate"].alias("negate")),
            ).otherwise(c)).cast(CONTENT_TYPE)

        next_items = (
            F.when(o["k"] == "content", added)
            .when(o["k"] == "nocase", modified(F.lit(True), F.lit(None).cast("int")))
            .when(o["k"] == "depth", modified(F.lit(False), o["v"].try_cast("int")))
            .otherwise(items)
        )
        next_buffer = F.when(_names_buffer(o), o["k"]).when(o["k"] == NO_BUFFER, "").otherwise(acc["buffer"])
        return F.struct(next_buffer.alias("buffer"), next_items.alias("items"))

    return F.aggregate("_options", start, step, lambda acc: acc["items"])


# --- matching ---------------------------------------------------------------

GRAM = 4
BODY = ["proto", "src", "src_port", "direction", "dst", "dst_port", "contents"]
#: Patterns that an automaton in every task may hold: some hundred bytes each.
MAX_PATTERNS = 200_000


def _address_ok(spec: Column, ip: Column) -> Column:
    return (
        F.when(spec == "any", True)
        .when(spec == "$HOME_NET", S.is_home(ip))
        .when(spec == "$EXTERNAL_NET", ~S.is_home(ip))
        .otherwise(False)
    )


def _port_ok(spec: Column, port: Column) -> Column:
    """``any``, a port, a range ``low:high`` with open ends, lists of these in brackets, and ``!`` before any of them."""
    whole = F.regexp_replace(spec, r"\s", "")
    turned = whole.startswith("!")
    parts = F.split(F.regexp_replace(whole, r"^!?\[?|\]$", ""), ",")

    def meets(part: Column) -> Column:
        ends = F.split(F.regexp_replace(part, "^!", ""), ":")
        low, high = F.get(ends, F.lit(0)), F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0)))
        least = F.when(low == "", 0).otherwise(low.try_cast("int"))
        most = F.when(high == "", 65_535).otherwise(high.try_cast("int"))
        return (part.isin("any", "!any")) | F.coalesce(port.between(least, most), F.lit(False))

    taken, left = F.filter(parts, lambda x: ~x.startswith("!")), F.filter(parts, lambda x: x.startswith("!"))
    listed = ((F.size(taken) == 0) | F.exists(taken, meets)) & ~F.exists(left, meets)
    return F.when(spec == "any", True).when(turned, ~listed).otherwise(listed)


def _header_ok() -> Column:
    """Addresses and ports from source to destination, for ``<>`` also the other way."""
    def way(src: str, src_port: str, dst: str, dst_port: str) -> Column:
        return (
            _address_ok(F.col("src"), F.col(src)) & _address_ok(F.col("dst"), F.col(dst))
            & _port_ok(F.col("src_port"), F.col(src_port)) & _port_ok(F.col("dst_port"), F.col(dst_port))
        )

    there = way("src_ip", "event_src_port", "dst_ip", "event_dst_port")
    back = way("dst_ip", "event_dst_port", "src_ip", "event_src_port")
    return there | ((F.col("direction") == "<>") & back)


def _grams(text: Column, size: int) -> Column:
    last = F.length(text) - size + 1
    positions = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(positions, lambda i: F.substr(text, i, F.lit(size)))


def _body_key() -> Column:
    return F.sha2(F.to_json(F.struct(*BODY)), 256)


def _usable() -> Column:
    """Rules with something to look for: at least one content that must be there."""
    return F.col("enabled") & F.exists("contents", lambda c: ~c["negate"])


def rule_bodies(rules: DataFrame) -> DataFrame:
    """Rules that test the same thing, once: a body and how to find it.

    The pattern is its longest content in lower case; a text that holds the
    content holds the pattern, and few texts hold a long one.
    """
    bodies = rules.filter(_usable()).select(*BODY).distinct()
    wanted = F.filter("contents", lambda c: ~c["negate"])
    longest = F.array_max(F.transform(wanted, lambda c: F.struct(F.length(c["text"]).alias("n"), F.lower(c["text"]).alias("text"))))
    return bodies.withColumn("body", _body_key()).withColumn("_pattern", longest["text"])


def _search(patterns: list[str]):
    """Arrow batches of (row, text) to (row, pattern) for every pattern that occurs in a text, by one automaton."""

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in patterns:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for b in batches:
            rows, found = [], []
            for k, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                hits = sorted({p for _, p in automaton.iter(text)}) if text else []
                rows += [k] * len(hits)
                found += hits
            taken = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:-1], pa.array(found, pa.string())], [*b.schema.names[:-1], "_pattern"])

    return run


def candidates(events: DataFrame, bodies: DataFrame) -> DataFrame:
    """Events with the bodies whose pattern occurs in their text, joined on protocol and pattern.

    Up to ``MAX_PATTERNS`` patterns are searched by an automaton, all at once in
    one pass over the text. Beyond that an event meets the patterns by their
    first ``GRAM`` characters in a join, and keeps those that it holds.
    """
    text = F.lower(F.array_join(F.map_values("buffers"), "\n"))
    patterns = [r[0] for r in bodies.filter("_pattern != ''").select("_pattern").distinct().limit(MAX_PATTERNS + 1).collect()]
    if len(patterns) <= MAX_PATTERNS:
        if not patterns:
            return events.join(bodies.filter("_pattern != ''"), "proto")
        schema = T.StructType([*events.schema.fields, T.StructField("_pattern", T.StringType())])
        keyed = events.withColumn("_text", text).mapInArrow(_search(patterns), schema)
        return keyed.join(bodies, ["proto", "_pattern"])
    grams = F.array_distinct(F.concat(*[_grams(text, n) for n in (1, 2, 3, GRAM)]))
    keyed = events.withColumn("_anchor", F.explode(grams))
    short = bodies.withColumn("_anchor", F.substring("_pattern", 1, GRAM))
    return keyed.join(short, ["proto", "_anchor"]).filter(F.contains(text, F.col("_pattern"))).drop("_anchor")


def match_events(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of event and rule body whose header and contents all match.

    ``events``: ``event_id, proto, src_ip, dst_ip, event_src_port,
    event_dst_port`` and ``buffers``, a map buffer name -> text. Events meet only the bodies whose pattern occurs in
    their text; contents are then tested in full. Rules with equal bodies share the work.
    """
    found = candidates(events, rule_bodies(rules))
    whole = F.array_join(F.map_values("buffers"), "\n")

    def holds(c: Column) -> Column:
        target = F.when(c["buffer"] == "", whole).otherwise(F.coalesce(F.try_element_at("buffers", c["buffer"]), F.lit("")))
        target = F.when(c["depth"].isNotNull(), F.substr(target, F.lit(1), c["depth"])).otherwise(target)
        there = F.when(c["nocase"], F.contains(F.lower(target), F.lower(c["text"]))).otherwise(F.contains(target, c["text"]))
        return there != c["negate"]

    return found.filter(_header_ok() & F.forall("contents", holds)).select("event_id", "body", *BODY)


def rule_hits(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Matched events per rule: counted per body, then given to its rules. The
    rules are parsed once."""
    keyed = cut_lineage(rules.filter(_usable()).select("rule_sid", "msg", "enabled", *BODY, _body_key().alias("body")))
    per_body = match_events(events, keyed).groupBy("body").agg(F.count(F.lit(1)).alias("hits"))
    return keyed.join(per_body, "body").select("rule_sid", "msg", "hits")
