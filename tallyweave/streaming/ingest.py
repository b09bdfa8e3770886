"""Transactions as a stream: bounded deduplication, the same enrichment as in batch, monthly totals, idempotent append."""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.narration import extracted
from ..operators import model, vocabulary
from ..operators.model import MONEY
from ..plans import build
from ..plans.storage import stored
from ..sources.ledger import SCHEMAS
from ..terms import LOOKBACK_DAYS


def source(spark: SparkSession, folder: str) -> DataFrame:
    """Files of transactions as they arrive."""
    return spark.readStream.schema(SCHEMAS["transaction"]).parquet(folder)


def deduplicated(stream: DataFrame, key: str = "transaction_id", ts: str = "transaction_date", lateness: str = f"{LOOKBACK_DAYS} days") -> DataFrame:
    """Each key once; the state goes as the watermark passes. Watermarks need a timestamp with time zone (UTC)."""
    return stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", lateness).dropDuplicatesWithinWatermark([key])


def append_batch(batch: DataFrame, i: int, folder: str, query: str) -> None:
    """Writes batch ``i`` of a query into a folder of its own, then names it in the log.

    What the log doesn't name isn't there for readers. A batch that comes again, or whose write ended before the log had
    it, is written anew in the same place, so each of its rows is there once.
    """
    at = f"{folder}/data/{query}/{i}"
    batch.write.mode("overwrite").parquet(at)
    entry = batch.sparkSession.range(1).select(F.lit(query).alias("query"), F.lit(i).cast("bigint").alias("batch"), F.lit(at).alias("path"))
    entry.coalesce(1).write.mode("overwrite").parquet(f"{folder}/log/{query}/{i}")


def committed(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches that the log names."""
    try:
        log = spark.read.option("recursiveFileLookup", "true").schema("path string").parquet(f"{folder}/log")
        paths = [r.path for r in log.collect()]  # a row for each batch
    except AnalysisException as e:  # before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        paths = []
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def run_fact(stream: DataFrame, root: str, folder: str, checkpoint: str, query: str = "fact") -> StreamingQuery:
    """Drains transactions as facts into ``folder``/fact, with the aliases and accounts of the warehouse at ``root``.

    Each batch reads the aliases anew, so strings that an increment has added meanwhile have their names. Strings that
    have none yet are facts without a name, and go with their counts to ``folder``/unseen, the next increment's vocabulary.
    """

    def write(batch: DataFrame, i: int) -> None:
        w = build.read(batch.sparkSession, root)
        rows = stored(extracted(batch, w["bank"]), "stream-extracted")
        append_batch(model.fact(rows, w["alias"], w["account"], checked=True), i, f"{folder}/fact", query)
        append_batch(vocabulary.vocabulary(rows).join(w["alias"], "merchant_raw", "left_anti"), i, f"{folder}/unseen", query)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily(stream: DataFrame, ts: str, amount: str, keys: list[str], lateness: str = f"{LOOKBACK_DAYS} days") -> DataFrame:
    """Totals per day and keys, for output mode update; a day's state goes as the watermark passes it."""
    rows = stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", lateness)
    totals = rows.groupBy(F.window("event_time", "1 day").alias("span"), F.col(ts).cast("date").alias("day"), *keys)
    return totals.agg(F.count("*").alias("txns"), F.sum(amount).alias("total")).select(F.col("span.start").alias("since"), "day", *keys, "txns", "total")


def run_totals(totals: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Drains changed ``totals`` into ``folder``, each batch into its own part, so a batch that comes twice changes nothing."""
    writer = totals.writeStream.outputMode("update").foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/batch={i}"))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly(written: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per calendar month and keys, from the newest of each day's totals that ``run_totals`` wrote."""
    last = F.max_by(F.struct("txns", "total"), "batch").alias("last")
    days = written.groupBy("since", "day", *keys).agg(last)
    return days.groupBy(F.trunc("day", "MM").alias("txn_month"), *keys).agg(F.sum("last.txns").alias("txns"), F.sum("last.total").cast(MONEY).alias("total"))


def append_new(batch: DataFrame, folder: str, key: str = "transaction_id", ts: str = "transaction_date") -> None:
    """Appends the rows whose key the folder doesn't have, so a batch that comes twice changes nothing.

    A row that comes again has its old time, so only what the folder has since the batch's first row, less the days that
    a repeated key may lie back, is compared. Rows without a time are compared with those without.
    """
    spark = batch.sparkSession
    rows = batch.dropDuplicates([key])
    since = rows.agg(F.min(ts)).first()[0]
    try:
        held = spark.read.schema(batch.schema).parquet(folder)
        recent = F.col(ts).isNull() if since is None else F.col(ts).isNull() | (F.col(ts) >= F.lit(str(since - timedelta(days=LOOKBACK_DAYS))).cast(batch.schema[ts].dataType))
        rows = rows.join(held.filter(recent).select(key), key, "left_anti")
    except Exception as e:  # the first batch finds no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.select(*batch.columns).write.mode("append").parquet(folder)


def run(stream: DataFrame, folder: str, checkpoint: str, key: str = "transaction_id", ts: str = "transaction_date") -> StreamingQuery:
    """Drains what is there into ``folder``."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, folder, key, ts)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
