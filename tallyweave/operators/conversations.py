"""Question logs and conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import questions


def threads(turns: DataFrame) -> DataFrame:
    """(conv_id, messages, last_turn, title): the title is the first message, squeezed to 60 characters."""
    first = F.trim(F.regexp_replace(F.min_by("text", "turn"), r"[ \t\r\n]+", " "))
    title = F.when(F.length(first) > 60, F.concat(F.rtrim(F.substring(first, 1, 59)), F.lit("…"))).otherwise(first)
    return turns.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), title.alias("title"))


def newest_threads(turns: DataFrame, limit: int = 50) -> DataFrame:
    """The threads with the latest turns, the newest first."""
    return threads(turns).orderBy(F.desc("last_turn"), F.desc("conv_id")).limit(limit)


def last_messages(turns: DataFrame, n: int = 6) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= n).select("conv_id", "turn", "role", "back")


def totals(turns: DataFrame) -> DataFrame:
    return turns.agg(F.count_distinct("conv_id").alias("threads"), F.count("*").alias("messages"))


def tagged(turns: DataFrame) -> DataFrame:
    """Turns with direction, period, threshold, intent and follow-up flags of their texts."""
    text = F.col("text")
    rows = turns.withColumns({"direction": questions.direction(text), "period": questions.period(text), "threshold": questions.threshold(text), "asked": questions.intent(text), "follows": questions.follows(text)})
    return rows.select("conv_id", "turn", "role", "direction", "period", "threshold", "asked.*", "follows")


def carried(tagged: DataFrame, *more: str) -> DataFrame:
    """Tags with direction, period and ``more`` columns, such as the counterparty, of earlier turns where a turn follows up; never for rankings and balances."""
    past = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    lean = F.col("follows") & ~F.col("intent").isin("rank", "balances")
    fill = lambda c: F.when(lean, F.coalesce(F.col(c), F.last(c, ignorenulls=True).over(past))).otherwise(F.col(c))
    return tagged.select("conv_id", "turn", "intent", "follows", *(fill(c).alias(c) for c in ("direction", "period", *more)))


def needs_person(asked: DataFrame, people: DataFrame) -> DataFrame:
    """(question_id, ask_person, candidates) of questions (question_id, entity_id, text, merchant_norm).

    A question about one person that names nobody is answered with a choice of the persons who sent the entity most,
    from ``people`` (entity_id, rank, merchant_norm).
    """
    known = people.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "merchant_norm"))), lambda p: p["merchant_norm"]).alias("people"))
    rows = asked.join(known, "entity_id", "left")
    ask = F.coalesce(questions.one_person(F.col("text")), F.lit(False)) & F.col("merchant_norm").isNull()
    return rows.select("question_id", ask.alias("ask_person"), F.when(ask, F.coalesce("people", F.array().cast("array<string>"))).alias("candidates"))


def needs_period(questions_: DataFrame, dim: DataFrame) -> DataFrame:
    """(question_id, ask_period) of questions (question_id, entity_id, merchant_norm, period, bounded).

    A period is asked for where the counterparty was active in several months, none is given and the listing has no
    other bound.
    """
    rows = questions_.join(dim.select("entity_id", "merchant_norm", "active_months"), ["entity_id", "merchant_norm"], "left")
    ask = (F.coalesce("active_months", F.lit(0)) > 1) & F.col("period").isNull() & ~F.col("bounded")
    return rows.select("question_id", ask.alias("ask_period"))
