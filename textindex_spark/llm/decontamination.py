"""Benchmark decontamination by spaced seeds. DataFrame functions only.

Tokens are lower-case runs of letters and digits. A document is contaminated by a benchmark item if, with the two laid
side by side at some shift, a stretch of WINDOW aligned tokens holds at most SUBSTITUTIONS unequal ones; an item of
SPAN to WINDOW - 1 tokens must be there whole and equal. Items of under SPAN tokens prove nothing and are not searched.

1. Seeds: each mask keeps WEIGHT of SPAN neighbouring positions and ignores the others. The two masks together hit every
   stretch of WINDOW tokens with up to SUBSTITUTIONS unequal ones, wherever these lie (a test tries all of them), so the
   search is exact. Hashes of the kept tokens are joined between items and documents.
2. Hits are reduced to distinct (doc_id, item_id, shift) with map-side combination, so a passage that many documents
   share is one row a document and shift.
3. The documents with hits are read again and each candidate shift is verified in full.

The item side is broadcast in parts of about BROADCAST_SEEDS rows of 24 bytes, by the seed's remainder; each part is one
more pass over the documents, which are not shuffled. Beyond MOST_PASSES of these the same join shuffles its seeds.

Defined results: null or empty texts, on either side, match nothing; null ids are ignored; repeated documents or items
give one row for each (doc_id, item_id), the best; ties in the best stretch go to the smallest shift; empty tables give
no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, read_table

#: Kept positions of the masks.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
WINDOW = 13
SUBSTITUTIONS = 2
BROADCAST_SEEDS = 2_000_000
MOST_PASSES = 16
BROADCAST_IDS = 2_000_000


def tokens_of(text: Column) -> Column:
    plain = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def token_hashes(text: Column) -> Column:
    return F.transform(tokens_of(text), lambda t: F.xxhash64(t))


def seeds(h: Column) -> Column:
    """Array of (hash, position) for each mask and each position of an array of token hashes.

    The mask's number seeds the hash, so that hits of different masks stay apart.
    """

    def of(m: int) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(h) - (SPAN - 1)),
            lambda i: F.struct(F.xxhash64(F.lit(m), *[F.element_at(h, i + k) for k in MASKS[m]]).alias("seed"), (i - 1).alias("at")),
        )

    empty = F.array().cast("array<struct<seed:bigint,at:int>>")
    return F.when(F.size(h) < SPAN, empty).otherwise(F.concat(*[of(m) for m in range(len(MASKS))]))


def seed_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id, shift): places where some mask agrees. shift: document position less item position."""
    item_seeds = materialize(
        items.where(F.col("item_id").isNotNull())
        .select("item_id", token_hashes(F.col("text")).alias("h"))
        .select("item_id", F.explode(let(F.col("h"), seeds)).alias("s"))
        .select("item_id", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at")).distinct(),
        "item-seeds",
    )
    placed = (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.explode(let(token_hashes(F.col("text")), seeds)).alias("s"))
        .select("doc_id", F.col("s.seed").alias("seed"), F.col("s.at").alias("at"))
    )
    passes = -(-item_seeds.count() // BROADCAST_SEEDS)
    if passes > MOST_PASSES:
        parts = [item_seeds]
    else:
        parts = [F.broadcast(item_seeds.where(F.pmod("seed", F.lit(passes)) == k)) for k in range(passes)] or [item_seeds]
    found = reduce(DataFrame.unionByName, [placed.join(p, "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")) for p in parts])
    return found.distinct()


def best_stretch(d: Column, t: Column, shift: Column) -> Column:
    """(equal, length, item_at) of the best verified stretch of document hashes d and item hashes t at a shift, or null.

    Of all stretches of the needed length with few enough unequal tokens, the one with most equal tokens, then the first.
    """
    need = F.least(F.lit(WINDOW), F.size(t))
    spare = F.when(F.size(t) >= WINDOW, F.lit(SUBSTITUTIONS)).otherwise(F.lit(0))
    start = F.greatest(F.lit(0), -shift)
    end = F.least(F.size(t), F.size(d) - shift)

    def runs(same: Column) -> Column:
        """The best stretch of an array of 0 and 1."""
        equal = lambda i: F.size(F.filter(F.slice(same, i, need), lambda x: x == 1))
        each = F.transform(F.sequence(F.lit(1), F.size(same) - need + 1), lambda i: F.struct(equal(i).alias("equal"), need.alias("length"), (start - i + 1).alias("neg_at")))
        return F.array_max(F.filter(each, lambda x: x["equal"] >= need - spare))

    same = F.transform(F.sequence(start, end - 1), lambda j: F.when(F.get(t, j) == F.get(d, j + shift), 1).otherwise(0))
    return F.when(end - start >= need, let(same, runs))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_equal, n_aligned, doc_at, item_at, n_shifts): each document and item that overlap.

    The positions, in tokens, are where the best verified stretch begins in either; n_shifts counts the shifts of the
    document's copy that verify.
    """
    hits = materialize(seed_hits(docs, items), "seed-hits")
    ids = hits.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    shifts = hits.groupBy("doc_id", "item_id").agg(F.collect_list("shift").alias("shifts"))
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("doc_id", token_hashes(F.col("text")).alias("d"))
    tests = items.select("item_id", token_hashes(F.col("text")).alias("t"))
    pairs = texts.join(shifts, "doc_id").join(tests, "item_id")
    checked = F.filter(
        F.transform("shifts", lambda s: F.struct(best_stretch(F.col("d"), F.col("t"), s).alias("b"), (-s).alias("neg"))),
        lambda x: x["b"].isNotNull(),
    )
    best = pairs.select("doc_id", "item_id", checked.alias("ok")).where(F.size("ok") > 0)
    best = best.select("doc_id", "item_id", F.array_max("ok").alias("m"), F.size("ok").alias("n_shifts"))
    best = best.groupBy("doc_id", "item_id").agg(F.max("m").alias("m"), F.max("n_shifts").alias("n_shifts"))
    at = -F.col("m.b.neg_at")
    return best.select(
        "doc_id", "item_id", F.col("m.b.equal").cast("int").alias("n_equal"), F.col("m.b.length").cast("int").alias("n_aligned"),
        (at - F.col("m.neg")).cast("int").alias("doc_at"), at.cast("int").alias("item_at"), F.col("n_shifts").cast("int").alias("n_shifts"),
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that overlap no item, with all their columns."""
    bad = contaminated(docs, items).select(F.col("doc_id").alias("bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["bad"], "left_anti")


def op7_decontamination(spark, sf_dir) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: Brute force over all shifts at which some five tokens agree in a row would miss none of the verified stretches: of 13
#: aligned tokens with two unequal ones, four in a row are equal. The SQL therefore seeds with any four tokens in a row.
ORACLE = f"""
WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w, row_number() OVER () AS rid FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w, row_number() OVER () AS rid FROM benchmark WHERE item_id IS NOT NULL),
dg AS (SELECT rid, p, array_to_string(list_slice(w, p, p + 3), ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 2)) AS p FROM d WHERE len(w) >= 4)),
tg AS (SELECT rid, p, array_to_string(list_slice(w, p, p + 3), ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 2)) AS p FROM t WHERE len(w) >= {SPAN})),
c AS (SELECT DISTINCT dg.rid AS dr, tg.rid AS tr, dg.p - tg.p AS shift FROM dg JOIN tg USING (g)),
a AS (SELECT dr, tr, shift, doc_id, item_id, least({WINDOW}, len(t.w)) AS need, CASE WHEN len(t.w) >= {WINDOW} THEN {SUBSTITUTIONS} ELSE 0 END AS spare, greatest(0, -shift) AS s, least(len(t.w), len(d.w) - shift) AS e, d.w AS dw, t.w AS tw
      FROM c JOIN d ON d.rid = dr JOIN t ON t.rid = tr),
p AS (SELECT *, unnest(range(s, e - need + 1)) AS pos FROM a WHERE e - s >= need),
v AS (SELECT doc_id, item_id, dr, tr, shift, pos, need, spare, list_sum(list_transform(range(pos, pos + need), lambda j: CASE WHEN tw[j + 1] = dw[j + shift + 1] THEN 1 ELSE 0 END))::INTEGER AS eq FROM p),
ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY eq DESC, need DESC, pos, shift) AS rn FROM v WHERE eq >= need - spare),
n AS (SELECT doc_id, item_id, max(k)::INTEGER AS n_shifts FROM (SELECT doc_id, item_id, dr, tr, count(DISTINCT shift) AS k FROM ok GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, item_id, eq AS n_equal, need::INTEGER AS n_aligned, (pos + shift)::INTEGER AS doc_at, pos::INTEGER AS item_at, n_shifts FROM ok JOIN n USING (doc_id, item_id) WHERE rn = 1"""
