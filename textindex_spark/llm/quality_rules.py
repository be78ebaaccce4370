"""Quality rules whose thresholds adapt to each language and source. DataFrame functions only.

One pass computes the base counts of every text and stores them (eight numbers a row). A mergeable quantile sketch of
each rule's ratio is kept for every (lang, source): counts in log-linear buckets (BITS significant bits, so a quantile
is off by less than 1/128 of its value, at any size and in any merge order). Sketches are summed with map-side
combination, so a hot source is one partial row per bucket and task. Quantiles of the sketches give the thresholds,
which are joined to the stored numbers; texts are never shuffled.

Most texts have no symbol, repeated line or repeated word at all, so plain ratios have no spread. A ratio goes into the
sketch with one occurrence more (of UNIT size) than the text has, in a text that much longer: what a text of this length
may have by chance. A threshold lies FENCE interquartile ranges above the third quartile of these, so it follows the
lengths and the habits of its group: groups of short texts, or with many such marks, get higher thresholds than others.
It is drawn to the language's threshold, and that to the whole table's, with the weight of PRIOR_ROWS rows; no number of
rows switches anything. A text fails only if its ratio with one occurrence less lies above the threshold.

Defined results: a null text has no words and fails the base rules; a null language or source is a group of its own;
repeated rows are judged each on its own and come out as often as they went in; ties fall in the same bucket; an empty
table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, materialize, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
#: Rules: name -> (numerator, denominator, parts, unit). A ratio is counted in whole parts; the unit is the size of one
#: occurrence: a mark of three characters, a line, a window that is found twice.
RULES = {
    "symbols": ("n_symbols", "n_words", 10_000, 3),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, 1),
    "repeats": ("n_repeat_words", "n_words", 10_000, 10),
    "word_length": ("word_chars", "n_words", 1000, 0),
}
FENCE = 5
PRIOR_ROWS = 50
#: Significant bits of a bucket.
BITS = 8
HALF = 1 << (BITS - 1)
#: A threshold table of at most this many rows (some 60 bytes each) may be broadcast.
BROADCAST_ROWS = 100_000


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words inside windows of `window` words that occur at least twice in the array.

    Windows are compared by 64-bit hash and sorted, so a text costs n log n. Only texts with a repeated window pay
    for the sort.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(window)]))

    def covered(positions: Column) -> Column:
        n = F.size(positions)
        gaps = F.zip_with(positions, F.slice(positions, 2, n), lambda p, q: F.least(F.lit(window), F.coalesce(q - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    def of_sorted(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        hit = F.filter(s, lambda x, i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), i)) | ((i < last) & same(F.least(i + 1, last), i)))
        return let(F.array_sort(F.transform(hit, lambda x: x["p"])), covered)

    def of_hashes(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(F.array_sort(pairs), of_sorted))

    return F.when(F.size(words) <= window, F.lit(0).cast("bigint")).otherwise(let(windows(words), of_hashes))


def base_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*[F.col(c) for c in keep], text.alias("_t"), words_of(F.col("text")).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    # the words pass through a struct so that they are split once for a row
    d = d.select(
        *keep,
        let(F.col("_w"), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("r"))).alias("_n"),
        _without(F.col("_t"), SPACE).cast("bigint").alias("word_chars"),
        (F.length("_t") - _without(F.col("_t"), SYMBOLS)).cast("bigint").alias("n_symbols"),
        counts.alias("_l"),
    )
    n, r = F.col("_n.n"), F.col("_n.r")
    return d.select(
        *keep, n.alias("n_words"), "word_chars", "n_symbols",
        F.col("_l.n").cast("bigint").alias("n_lines"), (F.col("_l.n") - F.col("_l.d")).cast("bigint").alias("n_dup_lines"),
        r.alias("n_repeat_words"), ((n < MIN_WORDS) | (100 * r > 20 * n)).alias("base_failed"),
    )


def _with_one(rule: str) -> Column:
    """The ratio with one occurrence more, in whole parts."""
    over, under, parts, unit = RULES[rule]
    return F.when(F.col(under) + unit > 0, F.expr(f"{parts} * ({over} + {unit}) div ({under} + {unit})")).otherwise(F.lit(0)).cast("bigint")


def _without_one(rule: str) -> Column:
    """The ratio with one occurrence less, in whole parts."""
    over, under, parts, unit = RULES[rule]
    return F.when(F.col(under) > 0, F.expr(f"{parts} * greatest({over} - {unit}, 0) div {under}")).otherwise(F.lit(0)).cast("bigint")


def bucket_of(x: Column) -> Column:
    """Index of the log-linear bucket of a whole number: exact below 2**BITS, then HALF buckets for each doubling."""
    drop = F.length(F.bin(x)) - BITS
    return F.when(x < 2 * HALF, x).otherwise(drop * HALF + F.call_function("shiftright", x, drop)).cast("bigint")


def bucket_top(b: Column) -> Column:
    """Largest number that falls in a bucket."""
    drop = F.greatest(F.floor(b / HALF) - 1, F.lit(0)).cast("int")
    mantissa = b - drop * HALF
    return F.when(b < 2 * HALF, b).otherwise(F.call_function("shiftleft", mantissa + 1, drop) - 1).cast("bigint")


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): the mergeable sketches, over rows that pass the base rules."""
    values = F.array(*[F.struct(F.lit(r).alias("rule"), bucket_of(_with_one(r)).alias("bucket")) for r in RULES])
    return (
        counts.where(~F.col("base_failed"))
        .select("lang", "source", F.explode(values).alias("v"))
        .groupBy("lang", "source", F.col("v.rule").alias("rule"), F.col("v.bucket").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, rule, rows, q1, q3) from sketches merged over the columns that by leaves out."""
    merged = sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "rule")
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("rows", F.sum("n").over(w))
    at = lambda a: F.min(F.when(4 * F.col("upto") >= a * F.col("rows"), bucket_top(F.col("bucket"))))
    return run.groupBy(*by, "rule").agg(F.max("rows").alias("rows"), at(1).alias("q1"), at(3).alias("q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, one limit for each rule): the adaptive threshold, drawn to that of the language and of the table."""
    limit = lambda d: d.withColumn("limit", F.col("q3") + FENCE * (F.col("q3") - F.col("q1"))).drop("q1", "q3")
    own = limit(quartiles(sketch, ["lang", "source"]))
    lang = limit(quartiles(sketch, ["lang"])).select(F.col("lang").alias("l2"), F.col("rule").alias("r2"), F.col("rows").alias("n2"), F.col("limit").alias("limit2"))
    whole = limit(quartiles(sketch, [])).select(F.col("rule").alias("r3"), F.col("limit").alias("limit3"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("rule") == F.col("r2"))).join(whole, F.col("rule") == F.col("r3"))
    drawn = F.expr(f"(rows * `limit` + {PRIOR_ROWS} * ((n2 * limit2 + {PRIOR_ROWS} * limit3) div (n2 + {PRIOR_ROWS}))) div (rows + {PRIOR_ROWS})")
    return joined.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r, drawn)).alias(f"max_{r}") for r in RULES])


def judge(docs: DataFrame) -> DataFrame:
    """Every row's counts, base verdict, ratios in parts, thresholds and the verdict `kept`."""
    counts = materialize(base_counts(docs), "rule-counts")
    limits = materialize(thresholds(sketches(counts)), "rule-limits")
    other = limits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[f"max_{r}" for r in RULES])
    if limits.count() <= BROADCAST_ROWS:
        other = F.broadcast(other)
    out = counts.join(other, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")
    for r in RULES:
        out = out.withColumn(f"parts_{r}", _without_one(r))
    fine = ~F.col("base_failed")
    for r in RULES:
        fine = fine & F.coalesce(F.col(f"parts_{r}") <= F.col(f"max_{r}"), F.lit(True))
    return out.withColumn("kept", fine)


def op10_quality_rules(spark, sf_dir) -> DataFrame:
    from .common import read_table

    return judge(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The same counts, sketches and verdicts in DuckDB's SQL."""
    more = {r: f"CASE WHEN {u} + {x} > 0 THEN {p} * ({o} + {x}) // ({u} + {x}) ELSE 0 END" for r, (o, u, p, x) in RULES.items()}
    less = {r: f"CASE WHEN {u} > 0 THEN {p} * greatest({o} - {x}, 0) // {u} ELSE 0 END" for r, (o, u, p, x) in RULES.items()}
    bucket = lambda x: f"CASE WHEN {x} < {2 * HALF} THEN {x} ELSE (length(bin({x})) - {BITS}) * {HALF} + ({x} >> (length(bin({x})) - {BITS})) END"
    values = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, {bucket('m_' + r)} AS bucket FROM c WHERE NOT base_failed" for r in RULES)
    top = f"CASE WHEN bucket < {2 * HALF} THEN bucket ELSE ((bucket - (bucket // {HALF} - 1) * {HALF} + 1) << (bucket // {HALF} - 1)::INTEGER) - 1 END"

    def level(name: str, by: str) -> str:
        keys = "".join(f"{k}, " for k in by.split())
        return (
            f"{name}_run AS (SELECT {keys}rule, bucket, (sum(n) OVER (PARTITION BY {keys}rule ORDER BY bucket))::BIGINT AS upto, (sum(n) OVER (PARTITION BY {keys}rule))::BIGINT AS rows_ FROM (SELECT {keys}rule, bucket, sum(n)::BIGINT AS n FROM sk GROUP BY ALL)), "
            f"{name} AS (SELECT {keys}rule, rows_, q3 + {FENCE} * (q3 - q1) AS lim FROM (SELECT {keys}rule, max(rows_) AS rows_, min(CASE WHEN 4 * upto >= rows_ THEN {top} END) AS q1, min(CASE WHEN 4 * upto >= 3 * rows_ THEN {top} END) AS q3 FROM {name}_run GROUP BY ALL))"
        )

    verdict = " AND ".join(f"coalesce(p_{r} <= max_{r}, true)" for r in RULES)
    drawn = f"((own.rows_ * own.lim + {PRIOR_ROWS} * ((bylang.rows_ * bylang.lim + {PRIOR_ROWS} * whole.lim) // (bylang.rows_ + {PRIOR_ROWS}))) // (own.rows_ + {PRIOR_ROWS}))::BIGINT"
    limits = ", ".join(f"max(CASE WHEN own.rule = '{r}' THEN {drawn} END) AS max_{r}" for r in RULES)
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, row_number() OVER () AS rid FROM documents),
grams AS (SELECT rid, p, list_slice(w, p, p + 4) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS p FROM t WHERE len(w) >= 5)),
hit AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p + k) AS r FROM hit, (SELECT unnest(range(5)) AS k) GROUP BY rid),
b AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN rep USING (rid)),
c AS (SELECT *, {", ".join(f"{v} AS m_{r}" for r, v in more.items())}, {", ".join(f"{v} AS p_{r}" for r, v in less.items())}, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
sk AS (SELECT lang, source, rule, bucket, count(*) AS n FROM ({values}) GROUP BY ALL),
{level("own", "lang source")}, {level("bylang", "lang")}, {level("whole", "")},
lim AS (SELECT own.lang, own.source, {limits} FROM own JOIN bylang ON own.lang IS NOT DISTINCT FROM bylang.lang AND own.rule = bylang.rule JOIN whole ON own.rule = whole.rule GROUP BY own.lang, own.source)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdict} AS kept
FROM c LEFT JOIN lim ON c.lang IS NOT DISTINCT FROM lim.lang AND c.source IS NOT DISTINCT FROM lim.source"""


ORACLE = _oracle()
