"""Ad-hoc SELECTs over one entity's views, in a session of their own.

The session sees two views and nothing else of the catalog; Spark's own parser admits a single query as a subquery.
Functions that call into the JVM are shadowed. The cap lies outside the text, so the text can't remove it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.privacy import masked, redacted_fields
from . import resolve

CAP = 200
_LITERAL = re.compile(r"'((?:''|[^'])*)'")
#: Literals, quoted names and comments, in which a question mark is no place for a parameter.
_QUOTED = re.compile(r"'(?:''|[^'])*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


class Unresolved(ValueError):
    """A filter names a counterparty that isn't known, or several; ``status``, ``value`` and ``candidates`` say which."""

    def __init__(self, status: str, value: str, candidates: list[str]):
        super().__init__(f"{value!r}: {status.lower().replace('_', ' ')}, near: {', '.join(candidates) or 'none'}")
        self.status, self.value, self.candidates = status, value, candidates

HEADLINE = ("amount", "total", "sum", "balance", "spend", "value")


def views(fact: DataFrame, account: DataFrame, bank: DataFrame, entity: str) -> dict[str, DataFrame]:
    """my_transactions and my_accounts of an entity, without sensitive columns."""
    own = fact.filter(F.col("entity_id") == entity).select(
        "transaction_id", "account_id", "transaction_date", "txn_month", "transaction_type", "transaction_amount", "channel", "merchant_norm", "counterparty_kind", "description"
    )
    accounts = account.filter(F.col("entity_id") == entity).join(bank, "bank_code", "left")
    accounts = accounts.select("account_id", masked(F.col("account_number")).alias("account_number"), "bank_name", "program_id", "available_balance")
    return {"my_transactions": redacted_fields(own, ["description"]), "my_accounts": accounts}


def named(spark: SparkSession, text: str, params: list, vocab: DataFrame, entity: str) -> tuple[str, list]:
    """``text`` and ``params`` with the counterparties that they filter by under their canonical names.

    Enums, numbers, days and periods stay. A value that is no counterparty of the entity, or may be several, raises
    ``Unresolved``, as the filter would find nothing and look like an answer.
    """
    values = {v for v in [*(p for p in params if isinstance(p, str)), *(x.replace("''", "'") for x in _LITERAL.findall(text))] if v.strip()}
    if not values:
        return text, params
    asked = spark.createDataFrame([(v, entity, v) for v in sorted(values)], "mention_id string, entity_id string, name string")
    known = {}
    for r in resolve.guarded(asked, vocab.filter(F.col("entity_id") == entity)).collect():  # a row for each value of one text
        if r.status in ("NOT_FOUND", "AMBIGUOUS"):
            raise Unresolved(r.status, r.mention_id, r.candidates)
        known[r.mention_id] = r.value if r.status == "MATCH" else r.mention_id
    quoted = lambda m: "'" + known.get(m[1].replace("''", "'"), m[1].replace("''", "'")).replace("'", "''") + "'"
    return _LITERAL.sub(quoted, text), [known.get(p, p) if isinstance(p, str) else p for p in params]


def run(spark: SparkSession, paths: dict[str, str], text: str, params: list | None = None, vocab: DataFrame | None = None, entity: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of a SELECT over stored views (name to Parquet path).

    summary has the number of rows shown and whether there are more. With ``vocab``, the names of ``entity``, what the
    text filters by is resolved before it runs.
    """
    params = params or []
    places = _QUOTED.sub(" ", text).count("?")
    if places != len(params):
        raise ValueError(f"{len(params)} parameters for {places} places")
    if vocab is not None:
        text, params = named(spark, text, params, vocab, entity)
    session = spark.newSession()
    for name, path in paths.items():
        session.read.parquet(path).createOrReplaceTempView(name)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name in ("reflect", "java_method", "try_reflect"):
        session.udf.register(name, lambda *_: None, "string")
    found = session.sql("SELECT * FROM (\n" + text + "\n) q", args=params).limit(CAP + 1)
    return found.limit(CAP), found.agg(F.least(F.count("*"), F.lit(CAP)).alias("shown"), (F.count("*") > CAP).alias("capped"))


def headline(rows: DataFrame) -> DataFrame | None:
    """Sum, highest, lowest and mean of the column that an answer is about, if there is one."""
    numeric = [f.name for f in rows.schema if f.dataType.typeName() in ("decimal", "double", "float", "long", "integer", "short") and not f.name.endswith("_id")]
    named = [c for h in HEADLINE for c in numeric if h in c.lower()]
    if not numeric:
        return None
    c = F.col((named or numeric)[0])
    return rows.agg(F.lit((named or numeric)[0]).alias("column"), F.count(c).alias("n"), F.sum(c).alias("sum"), F.max(c).alias("max"), F.min(c).alias("min"), F.avg(c.cast("double")).alias("mean"))


def weekend_counts(fact: DataFrame) -> DataFrame:
    """Per entity: transactions on weekdays and at weekends."""
    weekend = F.dayofweek("transaction_date").isin(1, 7)
    return fact.groupBy("entity_id").agg(F.count_if(~weekend).alias("weekday"), F.count_if(weekend).alias("weekend"))


def channels_by_month(fact: DataFrame) -> DataFrame:
    return fact.groupBy("txn_month", "channel").agg(F.count("*").alias("txns"), F.sum("transaction_amount").cast("decimal(25,2)").alias("total"))
