"""Mixing sources to target weights: repetition rates per source, whole copies and one more by chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, staged, whole_text

WEIGHTS = (5, 2, 1)
TOTAL_PERCENT = 150
MOST_REPEATS = 2
SEED = "mix"
_UNIT = 1 << 52


def word_count(text: str | Column = "text") -> Column:
    """Number of runs of characters that are not ASCII white space."""
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ranked(sources: DataFrame, name: str) -> DataFrame:
    """``sources`` with its place (from 0) by ``name`` in code point order, nulls last. Ranges of
    names are numbered side by side and shifted by the counts before them; no task sorts all."""
    dealt = staged(
        sources.repartitionByRange(F.col(name).asc_nulls_last()).withColumn(
            "__part", F.spark_partition_id()
        ),
        "sources",
    )
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(
        F.col("__part"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift")
    )
    inside = Window.partitionBy("__part").orderBy(F.col(name).asc_nulls_last())
    return (
        dealt.withColumn("__at", F.row_number().over(inside) - 1)
        .join(shift, "__part")
        .withColumn("place", F.col("__shift") + F.col("__at"))
        .drop("__part", "__at", "__shift")
    )


def source_targets(
    sizes: DataFrame,
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    total_percent: int = TOTAL_PERCENT,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size).

    Weights repeat over the sources in code point order, null last. The targets share
    ``total_percent`` of all sizes; one that would exceed ``most`` times its source's size stops
    there and the excess is reshared by weight until none is above. Each round brings three sums
    to the driver, exact integers.
    """
    totals = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")
    )
    table = staged(ranked(totals, source).withColumn("weight", weight.cast("long")), "weights")
    level = F.lit(0.0)
    capped_before = -1
    while True:
        over = F.col("weight") * level > most * F.col("source_size")
        # A source stopped once stays stopped: the level only rises.
        everything, stopped, open_weight, n_stopped = table.agg(
            F.sum("source_size"),
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
            F.count(F.when(over, 1)),
        ).first()
        if everything is None or n_stopped == capped_before or not open_weight:
            break
        capped_before = n_stopped
        level = F.lit((total_percent * everything - 100 * most * stopped) / (100 * open_weight))
    target = F.least(F.col("weight") * level, (most * F.col("source_size")).cast("double"))
    return table.select(source, "source_size", "weight", target.alias("target"))


def chance(ident: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the hash of seed and id; the same on every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(ident.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(_UNIT))


def mixing_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with size (words), source_size, target (its source's), rate and copies: floor(rate)
    whole copies, and one more if the hashed chance of the id falls below the fraction.

    Null text has size 0; a source without words has target and rate 0; null is a source of its
    own; repeated rows and ids each count and share their chance; empty tables give an empty plan.
    Columns of ``docs`` with these names are replaced.
    """
    made = ("size", "source_size", "target", "rate", "copies")
    docs = docs.drop(*[c for c in docs.columns if c in made and c not in (id_col, source, text)])
    name = fresh(docs, "__source")
    sized = docs.withColumn("size", word_count(text))
    targets = staged(source_targets(sized.select(source, "size"), source), "targets")
    targets = targets.select(F.col(source).alias(name), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor("rate")
    extra = (chance(F.col(id_col), seed) < F.col("rate") - whole).cast("long")
    return (
        sized.join(targets, sized[source].eqNullSafe(F.col(name)))
        .drop(name)
        .withColumn("rate", rate)
        .withColumn("copies", whole + extra)
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed rows: each row of ``docs`` as often as its plan says, with the columns of ``docs``."""
    # Under names of their own: the plan replaces columns with the names of its figures.
    names = [f"__in_{i}" for i in range(len(docs.columns))]
    at = {c.lower(): n for c, n in zip(docs.columns, names)}
    plan = mixing_plan(docs.toDF(*names), *[at[c.lower()] for c in (id_col, source, text)])
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    mixed = plan.where("copies > 0").select("*", each.alias("__copy")).select(*names)
    return mixed.toDF(*docs.columns)
