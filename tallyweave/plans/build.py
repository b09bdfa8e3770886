"""The warehouse: full builds and increments as versions of a folder.

A build writes a new version and names it in the manifest last, so readers see a whole version or the one before. An
increment reads a few days behind the watermark again, drops what the fact has of these days, keeps the aliases that
exist, and falls back to a full build when schemas or aliases have changed. It writes only what is new:

* a segment of the fact and one of the aliases; unseen strings are compared with the names that are there, and take
  their names and kinds where they are the same or alike;
* the months of the rollup that the segment touches, and the shares of the dimension that hold its entities. The rollup
  lies in folders by month, the dimension in folders by a hash of the entity, and the manifest says which version has
  the current one of each.

After ``SEGMENTS`` increments the next one compacts: segments become one again, as a new version. An increment without
news writes nothing.
"""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.narration import extracted
from ..operators import model, vocabulary
from ..sources.landing import fingerprint
from ..terms import ALIAS_VERSION, LOOKBACK_DAYS

#: Segments from which on the next increment compacts them, and shares of the dimension.
SEGMENTS, SHARES = 16, 32


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The latest manifest row."""
    try:
        rows = spark.read.parquet(f"{root}/manifest")
    except Exception as e:  # the folder is not there before the first build
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    row = rows.orderBy(F.desc("built_at"), F.desc("version")).limit(1).first()
    return row.asDict() if row else None


def _path(root: str, version: str, name: str) -> str:
    return f"{root}/{version}/{name}"


def _parts(spark: SparkSession, root: str, name: str, current: dict[str, str]) -> DataFrame:
    """A table of which each part lies in the version that ``current`` says."""
    versions: dict[str, list[str]] = {}
    for part, version in sorted(current.items()):
        versions.setdefault(version, []).append(part)
    out = None
    for version, parts in versions.items():
        rows = spark.read.parquet(_path(root, version, name)).filter(F.col("part").isin(*parts)).drop("part")
        out = rows if out is None else out.unionByName(rows)
    return out


def _read(spark: SparkSession, root: str, m: dict) -> dict[str, DataFrame]:
    out = {name: spark.read.parquet(*(_path(root, v, name) for v in m[f"{name}_segments"])) for name in ("fact", "alias")}
    out |= {name: _parts(spark, root, name, m[f"{name}_parts"]) for name in ("rollup", "dim") if m[f"{name}_parts"]}
    out |= {name: spark.read.parquet(_path(root, m["snapshot"], name)) for name in ("account", "bank")}
    return out


def read(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """alias, dim, rollup, account, bank and fact as the manifest names them."""
    m = manifest(spark, root)
    if m is None:
        raise FileNotFoundError(f"no build in {root}")
    return _read(spark, root, m)


def _clustered(rows: DataFrame, *order: str) -> DataFrame:
    """In ranges of months and entities, sorted: a question about a month or an entity reads few files and row groups."""
    return rows.repartitionByRange("txn_month", "entity_id").sortWithinPartitions("txn_month", "entity_id", "merchant_norm", *order)


def month_part(month: Column) -> Column:
    """The rollup's part of a month."""
    return F.coalesce(F.date_format(month, "'m'yyyy-MM"), F.lit("none"))


def share_part(entity: Column) -> Column:
    """The dimension's part of an entity."""
    return F.concat(F.lit("s"), F.pmod(F.xxhash64(entity), SHARES).cast("string"))


def _write_parts(rows: DataFrame, part: Column, at: str) -> None:
    rows.withColumn("part", part).write.partitionBy("part").parquet(at)


def _present(rows: DataFrame, part: Column) -> list[str]:
    return [r.part for r in rows.select(part.alias("part")).distinct().collect()]  # months, or shares


def _published(spark: SparkSession, root: str, m: dict) -> dict:
    """``m`` as the manifest's newest row."""
    schema = (
        "watermark timestamp_ntz, row_count bigint, schema_hash string, alias_map_version int, built_at timestamp, version string, snapshot string, "
        "fact_segments array<string>, alias_segments array<string>, rollup_parts map<string,string>, dim_parts map<string,string>"
    )
    names = [part.split(" ")[0] for part in schema.split(", ")]
    row = spark.createDataFrame([tuple(None if n == "built_at" else m[n] for n in names)], schema).withColumn("built_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return manifest(spark, root)


def _write_fact(rows: DataFrame, at: str) -> None:
    """Facts with Bloom filters, as large as their values need, on the two columns that are looked up by value."""
    writer = rows.write.option("parquet.bloom.filter.adaptive.enabled", "true")
    for name in {"transaction_reference_id", model.BLIND} & set(rows.columns):
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(at)


def _snapshots(tables: dict[str, DataFrame], at: str) -> None:
    for name in ("account", "bank"):
        tables[name].write.parquet(f"{at}/{name}")


def full(spark: SparkSession, tables: dict[str, DataFrame], root: str, cluster: bool = True, pepper: str | None = None) -> dict:
    """Extract, map and aggregate everything; returns the manifest. With a ``pepper`` facts have blind indexes."""
    version = f"v-{uuid.uuid4().hex[:12]}"
    at = f"{root}/{version}"
    rows = extracted(tables["transaction"], tables["bank"])
    rows.write.parquet(f"{at}/extracted")  # narrations are parsed once
    rows = spark.read.parquet(f"{at}/extracted")
    vocabulary.aliases(vocabulary.vocabulary(rows), cluster).write.parquet(f"{at}/alias")
    aliases = spark.read.parquet(f"{at}/alias")
    seen = Observation()
    fact = _clustered(model.fact(rows, aliases, tables["account"], checked=True, pepper=pepper), "transaction_date")
    _write_fact(fact.observe(seen, F.max("transaction_date").alias("watermark"), F.count("*").alias("row_count")), f"{at}/fact")
    _write_parts(_clustered(model.rollup(spark.read.parquet(f"{at}/fact"))), month_part(F.col("txn_month")), f"{at}/rollup")
    rollup = spark.read.parquet(f"{at}/rollup")
    _write_parts(model.dim_of_rollup(rollup.drop("part"), aliases).repartition("entity_id"), share_part(F.col("entity_id")), f"{at}/dim")
    _snapshots(tables, at)
    m = {"schema_hash": fingerprint(ALIAS_VERSION, pepper), "alias_map_version": ALIAS_VERSION, "version": version, "snapshot": version, "fact_segments": [version], "alias_segments": [version]}
    parts = {f"{name}_parts": {p: version for p in _present(df, F.col("part"))} for name, df in (("rollup", rollup), ("dim", spark.read.parquet(f"{at}/dim")))}
    return _published(spark, root, m | parts | {k: seen.get[k] for k in ("watermark", "row_count")})


def new_rows(transactions: DataFrame, fact: DataFrame, watermark: object) -> DataFrame:
    """Transactions from a few days before the watermark on that the fact doesn't have of these days, each once."""
    since = F.lit(watermark - timedelta(days=LOOKBACK_DAYS))
    recent = transactions.filter(F.col("transaction_date") >= since).dropDuplicates(["transaction_id"])
    return recent.join(fact.filter(F.col("transaction_date") >= since).select("transaction_id"), "transaction_id", "left_anti")


def compact(spark: SparkSession, root: str) -> dict:
    """The segments of fact and aliases as one each, in a new version; returns the manifest."""
    m, version = manifest(spark, root), f"v-{uuid.uuid4().hex[:12]}"
    old, at = _read(spark, root, m), f"{root}/{version}"
    _write_fact(_clustered(old["fact"], "transaction_date"), f"{at}/fact")
    old["alias"].repartition("merchant_raw").write.parquet(f"{at}/alias")
    for name, part in (("rollup", month_part(F.col("txn_month"))), ("dim", share_part(F.col("entity_id")))):
        _write_parts(old[name].repartition(part), part, f"{at}/{name}")
    parts = {f"{name}_parts": dict.fromkeys(m[f"{name}_parts"], version) for name in ("rollup", "dim")}
    return _published(spark, root, m | parts | {"version": version, "fact_segments": [version], "alias_segments": [version]})


def increment(spark: SparkSession, tables: dict[str, DataFrame], root: str, cluster: bool = True, pepper: str | None = None) -> dict:
    """Adds what is new; returns the manifest with ``before`` and ``added`` rows. Running it again adds nothing.

    With another ``pepper`` than the build's everything is built anew.
    """
    m = manifest(spark, root)
    if m is None or m["schema_hash"] != fingerprint(ALIAS_VERSION, pepper) or m["alias_map_version"] != ALIAS_VERSION:
        return full(spark, tables, root, cluster, pepper) | {"before": None, "added": None}
    old, version = _read(spark, root, m), f"v-{uuid.uuid4().hex[:12]}"
    at = f"{root}/{version}"
    seen = Observation()
    new = extracted(new_rows(tables["transaction"], old["fact"], m["watermark"]), tables["bank"])
    new.observe(seen, F.max("transaction_date").alias("watermark"), F.count("*").alias("rows")).write.parquet(f"{at}/extracted")
    if not seen.get["rows"]:
        return m | {"before": m["row_count"], "added": 0}
    if len(m["fact_segments"]) >= SEGMENTS:
        m = compact(spark, root)
        old = _read(spark, root, m)
    delta = spark.read.parquet(f"{at}/extracted")
    unseen = vocabulary.vocabulary(delta).join(old["alias"], "merchant_raw", "left_anti")
    known = old["dim"].groupBy("merchant_norm").agg(F.min("counterparty_kind").alias("counterparty_kind"), F.max("kind_confidence").alias("kind_confidence"), F.sum("txn_count").alias("freq"))
    vocabulary.aliases(unseen, cluster, known).write.parquet(f"{at}/alias")
    aliases = old["alias"].unionByName(spark.read.parquet(f"{at}/alias"))
    _write_fact(_clustered(model.fact(delta, aliases, tables["account"], checked=True, pepper=pepper), "transaction_date"), f"{at}/fact")
    fact = spark.read.parquet(f"{at}/fact")
    month, share = month_part(F.col("txn_month")), share_part(F.col("entity_id"))
    months, shares = _present(fact, month), _present(fact, share)
    first, last = fact.agg(F.min("txn_month"), F.max("txn_month")).first()
    near = F.col("txn_month").isNull() if first is None else F.col("txn_month").isNull() | F.col("txn_month").between(first, last)  # skips files
    rows = old["fact"].filter(near & month.isin(*months)).unionByName(fact)
    _write_parts(_clustered(model.rollup(rows)), month, f"{at}/rollup")
    current = m | {"version": version, "snapshot": version, "rollup_parts": m["rollup_parts"] | dict.fromkeys(months, version)}
    rollup = _parts(spark, root, "rollup", current["rollup_parts"]).filter(share.isin(*shares))
    _write_parts(model.dim_of_rollup(rollup, aliases).repartition("entity_id"), share, f"{at}/dim")
    _snapshots(tables, at)
    current["dim_parts"] = m["dim_parts"] | dict.fromkeys(shares, version)
    current |= {f"{name}_segments": [*m[f"{name}_segments"], version] for name in ("fact", "alias")}
    ends = [d for d in (m["watermark"], seen.get["watermark"]) if d is not None]
    current |= {"watermark": max(ends, default=None), "row_count": m["row_count"] + seen.get["rows"]}
    return _published(spark, root, current) | {"before": m["row_count"], "added": seen.get["rows"]}


def summary(fact: DataFrame) -> DataFrame:
    """Facts, entities, accounts, last day and coverage in one row."""
    known = F.count_if(F.col("merchant_norm") != "UNKNOWN").cast("double")
    return fact.agg(
        F.count("*").alias("facts"), F.count_distinct("entity_id").alias("entities"), F.count_distinct("account_id").alias("accounts"),
        F.max("transaction_date").cast("date").alias("anchor"), F.round(F.try_divide(known, F.count("*")), 6).alias("coverage"),
    )
