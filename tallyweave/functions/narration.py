"""Channel and counterparty from a narration, as one projection of built-in functions."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import FEE, FEE_MARKS, SELF, SELF_MARKS, STOPWORDS


def parts(text: Column) -> Column:
    """Trimmed parts of a narration, cut at the delimiter that it uses."""
    cut = F.when(text.contains("/"), F.split(text, "/")).when(text.contains(" - "), F.split(text, " - ")).when(text.contains("-"), F.split(text, "-")).otherwise(F.array(text))
    return F.transform(cut, F.trim)


def names(text: Column, stopwords: Column) -> Column:
    """The parts that can be a name: letters, no stopword, no masked account."""
    return F.filter(parts(text), lambda p: p.rlike("^[A-Za-z][A-Za-z .&'-]{2,}$") & ~F.array_contains(stopwords, F.upper(p)) & ~p.rlike("^X+$"))


def longest(found: Column) -> Column:
    """The longest name, the first of equal ones; null if there is none."""
    return F.aggregate(found, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)), x).otherwise(a))


def _any(marks: list[str], whole: bool) -> str:
    edge = r"\b" if whole else ""
    return "|".join(edge + re.escape(m).replace("\\ ", " ").replace("\\-", "-") + edge for m in marks)


def _holds(text: Column, marks: list[str]) -> Column:
    """Whether a text holds one of the marks, as bytes, which is far cheaper than a pattern."""
    return reduce(operator.or_, (text.contains(m) for m in marks))


def is_fee(text: Column) -> Column:
    # few texts hold a mark at all; only there its edges are looked at
    low = F.lower(text)
    return _holds(low, [m for m in FEE_MARKS if not any(o in m for o in FEE_MARKS if o != m)]) & low.rlike(rf"\b(?:{_any(FEE_MARKS, False)})\b")


def is_self(text: Column) -> Column:
    return _holds(F.lower(text), SELF_MARKS)


def channel(text: Column, fee: Column) -> Column:
    """Payment rail: fees first, then the prefix."""
    out = F.when(fee, "CHARGE")
    for prefix in ("UPI", "IMPS", "NEFT"):
        out = out.when(text.startswith(prefix), prefix)
    return out.when(text.startswith("RTGS") | text.startswith("R/"), "RTGS").when(text.startswith("FT ") | text.startswith("FT-"), "FT").otherwise("OTHER")


def month(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "MM")


def extracted(transactions: DataFrame, bank: DataFrame) -> DataFrame:
    """``transactions`` with channel, merchant_raw and txn_month.

    Bank codes are no names: they join the stopwords as a one-row table of distinct codes, which has a few rows only.
    """
    codes = F.collect_set(F.when(F.col("bank_code").isNotNull(), F.upper("bank_code")))
    stop = bank.agg(F.concat(F.array(*map(F.lit, STOPWORDS)), codes).alias("__stop"))
    text, best, fee = F.col("description"), F.col("__best"), F.col("__fee")
    # both are read more than once below, so they are columns of a projection of their own
    rows = transactions.crossJoin(F.broadcast(stop)).withColumns({"__fee": is_fee(text), "__best": longest(names(text, F.col("__stop")))})
    raw = F.when(fee, FEE).when(is_self(text), SELF).when(best.isNotNull(), F.trim(F.split_part(best, F.lit("  "), F.lit(1))))
    return rows.withColumns({"channel": channel(text, fee), "merchant_raw": raw, "txn_month": month(F.col("transaction_date"))}).drop("__stop", "__best", "__fee")


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_FEE_SQL, _SELF_SQL = (_any(m, w).replace("'", "''") for m, w in ((FEE_MARKS, True), (SELF_MARKS, False)))
#: The same for DuckDB, after the ledger's view.
ORACLE = f"""
stops AS (SELECT {_sql_list(STOPWORDS)} || list(DISTINCT upper(bank_code)) AS stop FROM bank),
cut AS (SELECT txn.*, CASE WHEN contains(description, '/') THEN string_split(description, '/') WHEN contains(description, ' - ') THEN string_split(description, ' - ')
                           WHEN contains(description, '-') THEN string_split(description, '-') ELSE [description] END AS parts FROM txn),
namely AS (SELECT cut.*, list_filter(list_transform(parts, lambda x: trim(x)), lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z .&''-]{{2,}}$')
                 AND NOT list_contains(stop, upper(x)) AND NOT regexp_matches(x, '^X+$')) AS names FROM cut, stops),
best AS (SELECT *, list_aggregate(list_transform(names, lambda x: length(x)), 'max') AS longest FROM namely),
extracted AS (SELECT transaction_id, account_id, transaction_date, transaction_type, description, transaction_amount, transaction_reference_id, utr_number,
       CASE WHEN regexp_matches(lower(description), '{_FEE_SQL}') THEN 'CHARGE'
            WHEN starts_with(description, 'UPI') THEN 'UPI' WHEN starts_with(description, 'IMPS') THEN 'IMPS' WHEN starts_with(description, 'NEFT') THEN 'NEFT'
            WHEN starts_with(description, 'RTGS') OR starts_with(description, 'R/') THEN 'RTGS'
            WHEN starts_with(description, 'FT ') OR starts_with(description, 'FT-') THEN 'FT' ELSE 'OTHER' END AS channel,
       CASE WHEN regexp_matches(lower(description), '{_FEE_SQL}') THEN '{FEE}' WHEN regexp_matches(lower(description), '{_SELF_SQL}') THEN '{SELF}'
            WHEN len(names) > 0 THEN trim(split_part(list_filter(names, lambda x: length(x) = longest)[1], '  ', 1)) END AS merchant_raw,
       CAST(date_trunc('month', transaction_date) AS DATE) AS txn_month FROM best)
"""
