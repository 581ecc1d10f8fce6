"""Mixing sources to target weights.

Words are summed for each source, targets and repetition rates follow from the
sums, and each document is emitted ``floor(rate)`` times plus one copy more by
a hash-seeded Bernoulli draw whose probability is the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Seeds tried for each source; the one whose draw comes nearest to the target is kept.
SEEDS = 32


def word_count(text: str = "text"):
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Each source's target.

    :param sizes: ``source, source_size``, one row for each source.
    :return: ``source, source_size, weight, target``.

    Sources by code point, null last, get the weights in turn. They share
    ``share`` of all words by weight; a target above ``most`` times its
    source's size stops there, and the excess is shared again by weight among
    the others until none is above. That is the level at which
    ``min(cap, level * weight)`` adds up to the total: sources are capped in
    the order of cap over weight, so one running sum finds it. The windows run
    over one row for each source, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", picked.alias("weight")).withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first())
    whole = Window.partitionBy()
    ranked = ranked.withColumns(
        {
            "total": share * F.sum("source_size").over(whole),
            "capped_before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_from": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    # The level if all sources before this one are capped and this one isn't; the first source that stays below its cap sets it.
    level = (F.col("total") - F.col("capped_before")) / F.col("weight_from")
    ranked = ranked.withColumn("level", F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("capped_before"), level.alias("level")))).over(whole)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def draw(doc_id: str, seed, key: str = "doc_id"):
    """A number in [0, 1) from a document's id and the seed."""
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string"), seed), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seeds: int = SEEDS) -> DataFrame:
    """How often the mix takes each document.

    :param docs: needs ``doc_id, text, source``; other columns are ignored.
    :return: ``doc_id, source, size, source_size, target, rate, copies, taken``, one row for each input row.

    ``copies`` is ``floor(rate)`` plus the draw. A source's draws all use one
    seed; of ``seeds`` candidates, all summed in one pass, that one is used
    whose words come nearest to the target. Reruns agree, since nothing but
    ids and seeds is drawn from. Rows of one ``doc_id`` share their draw. A
    null text has size 0; a null source is a source; a source without words
    has target 0 and rate 0; an empty table gives an empty one.
    """
    rows = cut(docs.select("doc_id", "source", word_count().alias("size")))
    sizes = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    rated = sizes.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)))
    fraction = F.col("rate") - F.floor("rate")
    joined = rows.join(rated.withColumnRenamed("source", "from"), F.col("source").eqNullSafe(F.col("from"))).drop("from", "weight")
    tried = joined.groupBy("source").agg(
        F.first("target").alias("target"),
        F.array(*[F.sum(F.col("size") * (F.floor("rate") + (draw("doc_id", F.lit(k)) < fraction).cast("long"))) for k in range(seeds)]).alias("sums"),
    )
    off = F.transform("sums", lambda x, i: F.struct(F.abs(x - F.col("target")).alias("off"), i.alias("seed")))
    best = cut(tried.select(F.col("source").alias("from"), F.array_min(off)["seed"].alias("seed")))
    return (
        joined.join(best, F.col("source").eqNullSafe(F.col("from")))
        .withColumn("copies", (F.floor("rate") + (draw("doc_id", F.col("seed")) < fraction).cast("long")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def emit(docs: DataFrame, mixed: DataFrame | None = None) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, with all its columns.

    Rows of one ``doc_id`` are taken equally often.
    """
    mixed = mix(docs) if mixed is None else mixed
    # Several rows of one id have one draw, but may lie in different sources.
    own, source, copies, copy = (unused(docs, x) for x in ("__id", "__source", "__copies", "__copy"))
    times = mixed.groupBy(F.col("doc_id").alias(own), F.col("source").alias(source)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    rows = docs.join(times, F.col("doc_id").eqNullSafe(F.col(own)) & F.col("source").eqNullSafe(F.col(source)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
