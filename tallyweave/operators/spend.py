"""Ledger questions for all entities at once; ``entity`` narrows a question to one.

Totals always come from all rows that match, listings say how many groups there are, and a direction is mandatory.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import previous, same_window
from ..terms import DIRECTIONS, NOT_RANKED
from .model import MONEY


def _scope(df: DataFrame, direction: str | None, merchant: str | None = None, kind: str | None = None, entity: str | None = None) -> DataFrame:
    for column, value in (("transaction_type", direction), ("merchant_norm", merchant), ("counterparty_kind", kind), ("entity_id", entity)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def _directed(direction: str) -> None:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")


def in_days(start: date | None, end: date | None) -> Column:
    """Half-open day window on timestamps; no bounds mean all."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col("transaction_date") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out & (F.col("transaction_date") < F.date_add(F.lit(end), 1).cast("timestamp_ntz"))
    return out


def routed(fact: DataFrame, rollup: DataFrame, start: date | None, end: date | None, month_aligned: bool) -> DataFrame:
    """Rows of one shape (amount, n, first_day, last_day and keys): the rollup's for whole months, else the fact's."""
    keys = ["entity_id", "merchant_norm", "counterparty_kind", "txn_month", "transaction_type"]
    if month_aligned:
        rows = rollup if start is None else rollup.filter(F.col("txn_month").between(F.lit(start), F.lit(end)))
        return rows.select(*keys, F.col("total_amount").alias("amount"), F.col("txn_count").alias("n"), F.col("min_date").alias("first_day"), F.col("max_date").alias("last_day"))
    day = F.col("transaction_date").cast("date")
    rows = fact.filter(in_days(start, end))
    return rows.select(*keys, F.col("transaction_amount").cast(MONEY).alias("amount"), F.lit(1).cast("bigint").alias("n"), day.alias("first_day"), day.alias("last_day"))


def _total(c: str = "amount") -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)


def spend_facts(rows: DataFrame, direction: str, merchant: str | None = None, kind: str | None = None, entity: str | None = None) -> DataFrame:
    """Per entity: total, count, counterparties, first and last day, average."""
    _directed(direction)
    out = _scope(rows, direction, merchant, kind, entity).groupBy("entity_id").agg(
        _total().alias("total"), F.sum("n").alias("txns"), F.count_distinct("merchant_norm").alias("merchants"),
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
    )
    return out.withColumn("average", F.round(F.try_divide(F.col("total").cast("double"), F.col("txns").cast("double")), 2))


def spend_by(rows: DataFrame, direction: str, key: str, **scope: str | None) -> DataFrame:
    """Per entity and ``key`` (merchant_norm or txn_month): total and count."""
    _directed(direction)
    return _scope(rows, direction, **scope).groupBy("entity_id", key).agg(_total().alias("total"), F.sum("n").alias("txns"))


def month_extremes(rows: DataFrame, direction: str, **scope: str | None) -> DataFrame:
    """Per entity: number of months, highest and lowest month, mean of the months."""
    months = spend_by(rows, direction, "txn_month", **scope)
    high, low = F.struct("total", "txn_month"), F.struct(F.col("total"), F.datediff(F.lit("2200-01-01").cast("date"), "txn_month"))
    return months.groupBy("entity_id").agg(
        F.count("*").alias("months"), F.max_by("txn_month", high).alias("top_month"), F.max("total").alias("top_total"),
        F.min_by("txn_month", low).alias("low_month"), F.min("total").alias("low_total"),
        F.round(F.avg(F.col("total").cast("double")), 2).alias("mean_total"),
    )


def top_counterparties(rows: DataFrame, direction: str, k: int = 10, kind: str | None = None, include_excluded: bool = False, entity: str | None = None) -> DataFrame:
    """Per entity the k counterparties with the highest totals, with what all of them add up to.

    Each row carries the entity's full total, its number of counterparties, whether the list is cut, and the total of
    the kinds that are left out of rankings.
    """
    _directed(direction)
    out = F.col("counterparty_kind").isin(*NOT_RANKED) & F.lit(kind is None and not include_excluded)
    per = _scope(rows, direction, kind=kind, entity=entity).groupBy("entity_id", "merchant_norm").agg(
        F.min("counterparty_kind").alias("counterparty_kind"), _total().alias("total"), F.sum("n").alias("txns"), F.bool_and(out).alias("excluded"))
    rank = Window.partitionBy("entity_id").orderBy(F.col("excluded"), F.desc("total"), "merchant_norm")
    best = per.withColumn("rank", F.row_number().over(rank)).filter((F.col("rank") <= k) & ~F.col("excluded"))
    shown = ~F.col("excluded")
    whole = per.groupBy("entity_id").agg(
        F.coalesce(F.sum(F.when(shown, F.col("total"))), F.lit(0)).cast(MONEY).alias("all_total"), F.count_if(shown).alias("groups"),
        F.coalesce(F.sum(F.when(~shown, F.col("total"))), F.lit(0)).cast(MONEY).alias("excluded_total"),
    )
    return best.join(whole, "entity_id").select(
        "entity_id", "rank", "merchant_norm", "counterparty_kind", "total", "txns", "all_total", "groups", (F.col("groups") > k).alias("truncated"), "excluded_total"
    )


def listing(fact: DataFrame, order_by: str = "date", ascending: bool = False, limit: int = 50, direction: str | None = None, merchant: str | None = None,
            kind: str | None = None, start: date | None = None, end: date | None = None, least: float | None = None, most: float | None = None, entity: str | None = None) -> DataFrame:
    """Per entity the first transactions by date or amount, with the number and sum of all that match."""
    limit = max(1, min(200, limit))
    rows = _scope(fact, direction, merchant, kind, entity).filter(in_days(start, end))
    if least is not None:
        rows = rows.filter(F.col("transaction_amount") >= least)
    if most is not None:
        rows = rows.filter(F.col("transaction_amount") <= most)
    key = F.col("transaction_amount" if order_by == "amount" else "transaction_date")
    order = [key.asc() if ascending else key.desc(), F.desc("transaction_date"), F.col("transaction_id")]
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order))).filter(F.col("rank") <= limit)
    whole = rows.groupBy("entity_id").agg(F.count("*").alias("matches"), _total("transaction_amount").alias("match_total"))
    columns = ["transaction_id", "transaction_date", "transaction_type", "merchant_norm", "transaction_amount"]
    return first.join(whole, "entity_id").select("entity_id", "rank", *columns, "matches", "match_total", (F.col("matches") > limit).alias("truncated"))


def extreme(fact: DataFrame, highest: bool = True, direction: str | None = None, entity: str | None = None) -> DataFrame:
    """Per entity the transaction with the highest or lowest amount, the latest of equal ones."""
    rows = _scope(fact, direction, entity=entity)
    amount = F.col("transaction_amount") if highest else -F.col("transaction_amount")
    one = F.struct("transaction_id", "transaction_date", "merchant_norm", "transaction_amount")
    return rows.groupBy("entity_id").agg(F.max_by(one, F.struct(amount, F.col("transaction_date"), F.col("transaction_id"))).alias("t")).select("entity_id", "t.*")


def compared(rows: DataFrame, direction: str, a: tuple[date, date], b: tuple[date, date], merchant: str | None = None, entity: str | None = None) -> DataFrame:
    """Per entity the totals of two windows of whole months in order, their difference and change in percent; one scan."""
    _directed(direction)
    (a0, a1), (b0, b1) = sorted([a, b])
    within = lambda s, e: F.col("txn_month").between(F.lit(s), F.lit(e))
    total = lambda s, e: F.coalesce(F.sum(F.when(within(s, e), F.col("amount"))), F.lit(0)).cast(MONEY)
    scoped = _scope(rows, direction, merchant, entity=entity).filter(within(a0, a1) | within(b0, b1))
    out = scoped.groupBy("entity_id").agg(total(a0, a1).alias("earlier"), total(b0, b1).alias("later"))
    change = F.round(F.try_divide((F.col("later") - F.col("earlier")).cast("double") * 100.0, F.nullif(F.col("earlier").cast("double"), F.lit(0.0))), 1)
    return out.withColumns({"delta": (F.col("later") - F.col("earlier")).cast(MONEY), "pct_change": change, "combined": (F.col("later") + F.col("earlier")).cast(MONEY)})


def baseline(windows: DataFrame) -> DataFrame:
    """(start, end) windows with the equal-length window before each: base_start, base_end."""
    start, end = previous(F.col("start"), F.col("end"))
    return windows.withColumns({"base_start": start, "base_end": end})


def compared_with(windows: DataFrame) -> DataFrame:
    """Windows (start, end, base_start, base_end) with the baseline that counts: the one before, where none is given or it is the window itself."""
    start, end = previous(F.col("start"), F.col("end"))
    own = F.col("base_start").isNull() | F.col("base_end").isNull() | same_window(F.col("start"), F.col("end"), F.col("base_start"), F.col("base_end"))
    return windows.withColumns({"base_start": F.when(own, start).otherwise(F.col("base_start")), "base_end": F.when(own, end).otherwise(F.col("base_end"))})


def unattributed(rows: DataFrame, direction: str | None = None) -> DataFrame:
    """Per entity the share of transactions without a counterparty."""
    known = F.sum(F.when(F.col("merchant_norm") == "UNKNOWN", F.col("n")).otherwise(0))
    return _scope(rows, direction).groupBy("entity_id").agg(F.round(F.coalesce(F.try_divide(known.cast("double"), F.sum("n").cast("double")), F.lit(0.0)), 6).alias("unattributed"))


def scope_text(merchant: Column, period: Column, direction: Column, kind: Column, account: Column) -> Column:
    """What an answer covers, as text; parts that are null are left out."""
    named = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label + ": "), c))
    return F.concat_ws("; ", named("counterparty", merchant), named("period", period), named("direction", direction), named("kind", kind), named("account", account))
