"""Mixing sources to target weights by Pareto order sampling.

Within a source a document is expected in the mix in proportion to its inclusion weight: the number of binary digits of
its word count, so that longer documents come more often; no document is expected more than ``most`` times. The whole
part of that number is certain and allotted first. What remains of it, between 0 and 1, is the document's inclusion:
documents are ranked by their random odds divided by the odds of their inclusion, and taken in that order until the
words that the source still lacks are filled: a sample of fixed size, counted in words, with unequal probabilities. The
document at the edge gives only the words still missing, so a source ends within a word of its target.

The edge is found without sorting a source in one task: ranks fall into about sqrt(n) bins, sums per bin are
pre-aggregated, and only the documents of the edge's own bin are ordered one by one. Expected numbers depend on the
weight alone, so they are solved on a table with a row per source and weight, at most 63 of a source.

Defined results: a null text has size 0; a null source is a source of its own and comes last; repeated rows are
documents of their own that draw the same number, as do rows without doc_id and with equal texts; with an empty table
nothing is returned. Random numbers come from doc_id, text and a seed, so reruns agree. Only doc_id, source and text are
read, other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: The plan has a row per source and inclusion weight; it is sent to all executors only up to this many rows.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 up to 1 that depends on doc_id, text and the seed alone."""
    none = F.lit("")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), none), F.lit(":"), F.md5(F.coalesce(text, none))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def inclusion_weight(size: Column) -> Column:
    """Binary digits of a document's word count."""
    return F.length(F.bin(size)).cast("bigint")


def targets(totals: DataFrame, weights: list[int], most: int) -> DataFrame:
    """(source, n, source_size, target) from (source, n, source_size).

    Sources share the sum of all sizes by weight; none gets more than ``most`` times its own size, and the excess is
    shared again by weight. Sorted by size per weight, those at their limit come first, so running sums suffice.
    The table has a row per source: this is metadata, not documents.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    past, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(past), F.lit(0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(past), F.lit(0))
    rows = rows.withColumns({"left": left, "share": share})
    rows = rows.withColumn("limited", F.col("cap") * F.col("share") < F.col("left") * F.col("weight"))
    first = F.struct(F.col("share"), F.col("left"))
    rows = rows.withColumn("open", F.max(F.when(~F.col("limited"), first)).over(whole))
    shared = F.col("open.left") * F.col("weight") / F.col("open.share")
    target = F.when(F.col("limited") | F.col("open").isNull(), F.col("cap").cast("double")).otherwise(shared.cast("double"))
    return rows.select("source", "n", "source_size", target.alias("target"))


def pareto_rank(chance: Column, inclusion: Column) -> Column:
    """Random odds over inclusion odds; null where the inclusion is 0."""
    return F.when(inclusion > 0, chance / (1 - chance) * (1 - inclusion) / inclusion)


def _bin(rank: Column, bins: Column) -> Column:
    """Bin of a Pareto rank; null where there is none."""
    return F.floor(rank / (1 + rank) * bins)


def expected(per: DataFrame, most: int) -> DataFrame:
    """``per`` (source, weight, words, target, ...) with copies, inclusion and rest.

    A document of a weight is expected ``copies`` + ``inclusion`` times: weight * left / share, or ``most`` if that is
    more, where what is capped leaves the others ``left`` words to share by words times weight. ``rest`` is what the
    source lacks when all copies are allotted.
    """
    by_weight = Window.partitionBy("source").orderBy("weight")
    heavier = Window.partitionBy("source").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    goal = F.round("target").cast("bigint")
    rows = per.withColumns(
        {
            "left": goal - most * F.coalesce(F.sum("words").over(heavier), F.lit(0)),
            "share": F.sum(F.col("words") * F.col("weight")).over(by_weight.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    is_open = F.col("weight") * F.col("left") < most * F.col("share")
    rows = rows.withColumn("open", F.max(F.when(is_open, F.struct("weight", "left", "share"))).over(whole))
    capped = F.col("open").isNull() | (F.col("weight") > F.col("open.weight"))
    times = F.when(capped, F.lit(float(most))).otherwise((F.col("weight") * F.col("open.left")).cast("double") / F.col("open.share"))
    rows = rows.withColumn("times", F.when(F.col("source_size") > 0, times).otherwise(0.0))
    rows = rows.withColumn("copies", F.floor("times").cast("bigint"))
    rows = rows.withColumns({"inclusion": F.col("times") - F.col("copies"), "rest": goal - F.sum(F.col("copies") * F.col("words")).over(whole)})
    return rows.drop("left", "share", "open", "times")


def plan(rows: DataFrame, weights: list[int], most: int) -> DataFrame:
    """A row per source and inclusion weight: the source's target, copies, inclusion, and where its sample ends.

    ``rows`` has source, size, weight and chance of each document.
    """
    per = rows.groupBy("source", "weight").agg(F.count("*").alias("k"), F.sum("size").alias("words"))
    per = stored(per, "mix-weights")
    totals = per.groupBy("source").agg(F.sum("k").alias("n"), F.sum("words").alias("source_size"))
    goals = targets(totals, weights, most).withColumnRenamed("source", "named")
    per = per.join(goals, F.col("source").eqNullSafe(F.col("named"))).drop("named", "k")
    per = stored(expected(per, most).withColumn("bins", F.ceil(F.sqrt("n"))).drop("words", "n"), "mix-plan")
    binned = joined(rows, per).withColumn("bin", _bin(pareto_rank(F.col("chance"), F.col("inclusion")), F.col("bins")))
    sums = binned.filter("bin is not null").groupBy("source", "bin", "rest").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    edges = sums.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    edges = edges.select(F.col("source").alias("at"), F.col("bin").alias("edge"), "before")
    return per.join(edges, F.col("source").eqNullSafe(F.col("at")), "left").drop("at")


def joined(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Rows with the plan of their source and weight; the plan is small and a hot source moves nowhere."""
    per = per.withColumnsRenamed({"source": "planned", "weight": "planned_weight"})
    if per.count() <= BROADCAST_ROWS:
        per = F.broadcast(per)
    same = F.col("source").eqNullSafe(F.col("planned")) & (F.col("weight") == F.col("planned_weight"))
    return rows.join(per, same, "inner").drop("planned", "planned_weight")


def taken(rows: DataFrame, weights: list[int], most: int = 3, planned: DataFrame | None = None) -> DataFrame:
    """``rows`` (doc_id, source, size, weight, chance, ...) with source_size, target, copies and taken (words, repeats counted)."""
    per = stored(planned if planned is not None else plan(rows, weights, most), "mix-edges")
    ranked = joined(rows, per).withColumn("rank", pareto_rank(F.col("chance"), F.col("inclusion")))
    binned = ranked.withColumn("bin", _bin(F.col("rank"), F.col("bins")))
    kept = [*rows.columns, "source_size", "target", "copies"]
    inside = F.when(F.col("bin") < F.col("edge"), F.col("size")).otherwise(0)
    away = binned.filter(~F.coalesce(F.col("bin") == F.col("edge"), F.lit(False))).select(*kept, inside.alias("sampled"))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = binned.filter(F.col("bin") == F.col("edge"))
    lacking = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    edge = edge.select(*kept, F.greatest(F.lit(0), F.least(F.col("size"), lacking)).alias("sampled"))
    both = away.unionByName(edge)
    return both.withColumn("taken", F.col("copies") * F.col("size") + F.col("sampled")).drop("sampled")


def _drawn(seed: int) -> list[Column]:
    """size, weight and chance of each document."""
    size = word_count(F.col("text"))
    return [size.alias("size"), inclusion_weight(size).alias("weight"), uniform(F.col("doc_id"), F.col("text"), seed).alias("chance")]


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, weight, chance) of each document."""
    return docs.select("doc_id", "source", *_drawn(seed))


def mix_table(docs: DataFrame, weights: list[int], most: int = 3, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words the mix takes of each document."""
    rows = stored(sizes(docs, seed), "mix-sizes")
    return taken(rows, weights, most).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: list[int], most: int = 3, seed: int = 1) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row per whole copy, and the first words of the documents at the edges."""
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), "doc_id", "source", *_drawn(seed))
    out = taken(rows, weights, most, plan(stored(sizes(docs, seed), "mix-sizes"), weights, most))
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.col("copies")).cast("int")
    part = F.when(F.col("size") > 0, F.expr("taken % size")).otherwise(F.lit(0)).cast("int")
    repeats = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.expr("cast(array() as array<int>)")))
    out = out.select("row", F.explode(repeats).alias("first"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0))
    text = F.when(F.col("first") > 0, F.array_join(F.slice(words, F.lit(1), F.col("first")), " ")).otherwise(F.col("row.text"))
    return out.select(*(text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names))
