r"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Measures of a text are Spark expressions; ``RULES`` names a measure, the least and the greatest value that a text may
have, and is compiled into one array of the names of the rules that a text fails. Another table is another list.

Words are runs of anything but ``[\x20\x09-\x0D]``. The words in repeated 3-word windows are found inside the row: the
windows are sorted with their positions (by hash, then by the words themselves, so a collision changes nothing),
equal neighbours are repeats, and the positions they cover are counted as a union of intervals. This costs
n log n for n words and a few times the memory of the row's own text; no row meets another, so nothing is shuffled,
and a hot source or a large group of copies is dealt like any other rows.

Stop words count whatever the language of a text: the list joins those of four languages.

Defined results: a null text has no words, lines or symbols and fails the base; a text with under three words has no
window; ratios over no words, lines or letters are 0; ids may be null or repeated, every row is judged; an empty
table gives an empty result; ``judge`` ignores extra columns, ``keep_good`` keeps all columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"

#: Base: the least number of words, and the greatest percentage of words in repeated windows.
BASE_WORDS = 50
BASE_REPEATED = 50

#: (rule, measure, least, greatest); None is no bound.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("too_long", "n_words", None, 100_000),
    ("word_length", "mean_word", 3.0, 10.0),
    ("symbols", "symbols_per_word", None, 0.1),
    ("stop_words", "stop_share", 0.01, None),
    ("letters", "letter_share", 0.7, None),
    ("capitals", "upper_share", None, 0.4),
    ("repeated_lines", "dup_line_share", None, 0.3),
    ("ellipses", "ellipsis_share", None, 0.3),
    ("bullets", "bullet_share", None, 0.9),
)

#: Stop words of English, German, French and Spanish.
STOP_WORDS = tuple(sorted(set((
    "the be to of and that have with is in a for on as "
    "der die das und ist von zu den mit ein im auf für "
    "le la les de des et un une en que du est dans pour "
    "el los las y un una en que por con del se es"
).split())))


def _without(text: Column, pattern: str) -> Column:
    """Code points that are left when the pattern is taken out."""
    return F.length(F.regexp_replace(text, pattern, ""))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _repeat_words(windows: Column) -> Column:
    """Positions covered by windows that equal a neighbour in the sorted array."""
    def same(k: Column, other: Column) -> Column:
        a, b = F.get(windows, k), F.get(windows, other)
        return F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))

    at = F.when(F.size(windows) > 1, F.sequence(F.lit(0), F.size(windows) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.sort_array(F.transform(
        F.filter(at, lambda k: same(k, k + 1) | ((k > 0) & same(k, k - 1))), lambda k: F.get(windows, k)["i"]
    ))
    empty = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        starts, empty,
        lambda acc, i: F.struct((i + 3).alias("end"), (acc["total"] + i + 3 - F.greatest(acc["end"], i)).alias("total")),
        lambda acc: acc["total"],
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, measures...) for every row; ``keep`` names further columns to carry."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select(
        *keep, "doc_id", "text", F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^ \t-\r]")).alias("lines"),
    )
    n = F.size("words")
    word = lambda i: F.get("words", i)
    windows = F.sort_array(F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("h"),
            F.struct(word(i).alias("a"), word(i + 1).alias("b"), word(i + 2).alias("c")).alias("g"), i.alias("i"),
        ),
    ))
    rows = rows.select(
        *keep, "doc_id", n.cast("long").alias("n_words"), F.size("lines").alias("n_lines"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop"),
        F.size(F.filter("lines", lambda line: line.rlike(r"(\.\.\.|…)[ \t-\r]*$"))).alias("n_ellipsis"),
        F.size(F.filter("lines", lambda line: line.rlike(r"^[ \t-\r]*[*•-]"))).alias("n_bullet"),
        _without(F.col("text"), r"[^\p{L}]+").alias("n_letters"), _without(F.col("text"), r"[^\p{Lu}]+").alias("n_upper"),
        windows.alias("windows"),
    )
    return rows.select(
        *keep, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", _repeat_words(F.col("windows")).alias("n_repeat_words"),
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word"),
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        _ratio(F.col("n_stop"), F.col("n_words")).alias("stop_share"),
        _ratio(F.col("n_letters"), F.col("word_chars")).alias("letter_share"),
        _ratio(F.col("n_upper"), F.col("n_letters")).alias("upper_share"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        _ratio(F.col("n_ellipsis"), F.col("n_lines")).alias("ellipsis_share"),
        _ratio(F.col("n_bullet"), F.col("n_lines")).alias("bullet_share"),
    )


def compiled(rules=RULES) -> Column:
    """The names of the rules that a measured row fails."""
    failed = []
    for name, measure, least, greatest in rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(measure) < least)
        if greatest is not None:
            bad = bad | (F.col(measure) > greatest)
        failed.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, measures..., failed, base_failed, kept) for every row."""
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATED * F.col("n_words"))
    return measured(docs, id_col, text_col, keep).select("*", compiled(rules).alias("failed"), base.alias("base_failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0)
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return judge(whole, "id", "body", rules, ("row",)).filter("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_rule(measure: str, least: float | None, greatest: float | None) -> str:
    bounds = [f"{measure} < {least}"] if least is not None else []
    bounds += [f"{measure} > {greatest}"] if greatest is not None else []
    return "(" + " or ".join(bounds or ["false"]) + ")"


_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE_SQL = rf"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
parts as (
    select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from texts
),
windows as (
    select doc_id, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
    from (select doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) as i from parts)
),
often as (select doc_id, a, b, c from windows group by all having count(*) > 1),
covered as (
    select doc_id, count(distinct p) as n_repeat_words
    from (select w.doc_id, unnest([w.i, w.i + 1, w.i + 2]) as p from windows w join often using (doc_id, a, b, c))
    group by doc_id
),
counted as (
    select p.doc_id, len(words)::bigint as n_words, len(lines) as n_lines,
        length(array_to_string(words, ''))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        len(list_filter(words, lambda x: lower(x) in ({_LIST}))) as n_stop,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) as n_ellipsis,
        len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[*\x{{2022}}-]'))) as n_bullet,
        length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) as n_letters,
        length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) as n_upper,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words
    from parts p left join covered using (doc_id)
),
ratios as (
    select *, n_words < {BASE_WORDS} or 100 * n_repeat_words > {BASE_REPEATED} * n_words as base_failed,
        case when n_words > 0 then word_chars::double / n_words else 0 end as mean_word,
        case when n_words > 0 then n_symbols::double / n_words else 0 end as symbols_per_word,
        case when n_words > 0 then n_stop::double / n_words else 0 end as stop_share,
        case when word_chars > 0 then n_letters::double / word_chars else 0 end as letter_share,
        case when n_letters > 0 then n_upper::double / n_letters else 0 end as upper_share,
        case when n_lines > 0 then n_dup_lines::double / n_lines else 0 end as dup_line_share,
        case when n_lines > 0 then n_ellipsis::double / n_lines else 0 end as ellipsis_share,
        case when n_lines > 0 then n_bullet::double / n_lines else 0 end as bullet_share
    from counted
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and not ({" or ".join(_sql_rule(m, lo, hi) for _, m, lo, hi in RULES)}) as kept
from ratios
"""
