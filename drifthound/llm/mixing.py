"""Mixing sources to target weights along a curriculum.

Targets: sources in code point order (null last) get the weights 3, 1, 2,
repeating; together they may take `share` of all words, each at most `cap`
times its own. The excess of a capped source goes to the others by weight. That
is water-filling: sources are sorted by cap / weight, and the first level that
no further source exceeds is the final one.

Taking: a source in the order of md5(id) is repeated target / size times; each
document is taken floor(target / size) times, and once more while the middle of
its words lies below the rest. So a source misses its target by at most half a
document.

Curriculum: source number i has the weight schedule w(t) = 1 + a(2t - 1) over
training time t in [0, 1], a = slopes[i]. Its integral W(t) = t + a(t^2 - t) is
the share of the target demanded by time t; inverting it at a document's
cumulative words gives its position, and documents are range-sorted by it.

Null and empty texts have size 0 and are taken 0 words (they keep one row in
`taken_words`); repeated rows each take part; an empty table gives an empty
result; other columns pass through in `mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_WORD, prefix_sums, unused

WEIGHTS = (3, 1, 2)
SLOPES = (-0.8, 0.0, 0.8)


def _cycled(values: tuple, index: str) -> str:
    return f"element_at(array({', '.join(str(v) for v in values)}), cast({index} % {len(values)} as int) + 1)"


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """`totals` has one row per source (source, source_size); adds target and slope."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("_i", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumns({
        "_w": F.expr(_cycled(weights, "_i")).cast("double"), "slope": F.expr(_cycled(slopes, "_i")).cast("double"),
        "_cap": F.col("source_size") * F.lit(cap),
    })
    full = W.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before = full.rowsBetween(W.unboundedPreceding, -1)
    levels = ranked.select(
        "*", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_capped"),
        F.sum("_w").over(W.orderBy(F.col("_cap") / F.col("_w"), "_i").rowsBetween(0, W.unboundedFollowing)).alias("_weights"),
        F.sum("source_size").over(W.partitionBy(F.lit(0))).alias("_all"),
    ).withColumn("_level", (F.col("_all") * F.lit(share) - F.col("_capped")) / F.col("_weights"))
    # from the first source that does not reach its cap on, all get that source's level
    ranked_levels = levels.withColumn("_n", F.row_number().over(full))
    first = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_n", "_level"))).over(W.partitionBy(F.lit(0)))
    chosen = ranked_levels.withColumn("_first", first)
    target = F.when(F.col("_first").isNull() | (F.col("_n") < F.col("_first._n")), F.col("_cap")).otherwise(F.col("_first._level") * F.col("_w"))
    return chosen.select("source", "source_size", target.alias("target"), "slope")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, positions."""
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("_order"),
        *[F.col(c).alias(f"_c_{c}") for c in carry],
    )
    placed = prefix_sums(rows, ["source", "_order", "_id", "size"], ["size"], group="source")
    totals = placed.groupBy("source").agg(F.max("size_total").alias("source_size"))
    targets = source_targets(totals, weights, share, cap, slopes).select(F.col("source").alias("_s"), "target", "slope")
    # one row per source: Spark broadcasts it while it is small, and joins by key beyond
    both = placed.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnRenamed("size_total", "source_size")
    both = both.withColumn("_base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    rest = F.col("target") - F.col("_base") * F.col("source_size")
    both = both.withColumn("copies", F.when(F.col("size") > 0, F.col("_base") + (F.col("size_before") * 2 + F.col("size") < rest * 2).cast("long")).otherwise(0))
    share_of = "least(1D, (p * source_size + size_before + size / 2D) / target)"
    at = f"CASE WHEN slope = 0 THEN {share_of} ELSE (sqrt(power(1 - slope, 2) + 4 * slope * {share_of}) - (1 - slope)) / (2 * slope) END"
    both = both.withColumn("positions", F.expr(f"CASE WHEN copies > 0 THEN transform(sequence(0L, copies - 1), p -> {at}) ELSE cast(array() as array<double>) END"))
    return both.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "copies", "positions", *[F.col(f"_c_{c}").alias(c) for c in carry])


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", position_col: str | None = None, **options) -> DataFrame:
    """The mixed documents themselves, repeats as rows, range-sorted by training position.

    With `position_col`, the position is a last column of that name.

    Positions are found on narrow rows; the texts are shuffled once to meet
    them, and once by position.
    """
    key, nth, places, place = unused(docs, "mix_key", "mix_nth", "mix_places", "mix_place")
    hashed = F.xxhash64(id_col, text_col)
    number = F.row_number().over(W.partitionBy(key).orderBy(key))  # repeated rows meet one by one
    narrow = mix(docs.select(id_col, text_col, source_col, hashed.alias(key)), id_col, text_col, source_col, carry=(key,), **options)
    taken = narrow.filter(F.size("positions") > 0).select(key, F.col("positions").alias(places)).withColumn(nth, number)
    rows = docs.withColumn(key, hashed).withColumn(nth, number)
    placed = rows.join(taken, [key, nth]).withColumn(place, F.explode(places))
    return placed.orderBy(place, id_col).select(*docs.columns, *([F.col(place).alias(position_col)] if position_col else []))
