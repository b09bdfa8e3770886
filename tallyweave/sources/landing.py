"""Landing: files or JDBC tables to Parquet, checks of what a source has, exports and the manifest."""

from __future__ import annotations

import hashlib
import hmac
import json
from datetime import date
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ledger import PAYOUT_SCHEMAS, SCHEMAS, renamed

_DRIVERS = {
    "mysql": ("com.mysql.cj.jdbc.Driver", "mysql"),
    "mariadb": ("com.mysql.cj.jdbc.Driver", "mysql"),
    "postgres": ("org.postgresql.Driver", "postgresql"),
    "postgresql": ("org.postgresql.Driver", "postgresql"),
    "sqlite": ("org.sqlite.JDBC", "sqlite"),
    "duckdb": ("org.duckdb.DuckDBDriver", "duckdb"),
    "derby": ("org.apache.derby.jdbc.EmbeddedDriver", "derby"),
}
#: How a table is read in parts: by the column, its bounds and the number of parts.
SPLIT = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
#: The column that takes the lines of a CSV file which don't fit its schema.
CORRUPT = "corrupt"


def read_files(spark: SparkSession, folder: str, schemas: dict | None = None) -> dict[str, DataFrame]:
    """Each logical table from <name>.parquet or else <name>.csv, under its declared schema."""
    out = {}
    for name, schema in (schemas or SCHEMAS).items():
        for kind in ("parquet", "csv"):
            path = f"{folder.rstrip('/')}/{name}.{kind}"
            if _exists(spark, path):
                out[name] = spark.read.parquet(path) if kind == "parquet" else spark.read.schema(schema).csv(path, header=True)
                break
        else:
            raise FileNotFoundError(f"{folder} has neither {name}.parquet nor {name}.csv")
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header under its declared schema, in parts as Spark cuts it.

    A line that doesn't fit stays as a row: what could be read of it, and the line itself in ``corrupt``, null for
    others. A header with other names than the schema's is refused. Quotes within quoted fields are doubled.
    To count broken lines, read another column as well: Spark refuses queries on ``corrupt`` alone.
    """
    declared = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.csv(path, schema=declared, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=False, escape='"')


def read_payout_files(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five files of vendor payouts, <name>.csv each."""
    return {name: read_csv(spark, f"{folder.rstrip('/')}/{name}.csv", schema) for name, schema in PAYOUT_SCHEMAS.items()}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def jdbc_options(url: str, table: str, insecure: bool = False, ca: str | None = None) -> dict[str, str]:
    """Options of Spark's JDBC reader for a database address; TLS is on unless it is switched off by name."""
    u = urlparse(url)
    scheme = u.scheme.split("+")[0]
    if scheme not in _DRIVERS:
        raise ValueError(f"unknown source {scheme!r}")
    driver, name = _DRIVERS[scheme]
    asked = {k: v[0] for k, v in parse_qs(u.query).items() if k in ("fetchsize", *SPLIT)}
    asked["preferTimestampNTZ"] = "true"  # times as the schemas have them, so conditions on them reach the database
    if name in ("sqlite", "duckdb", "derby"):
        return {"url": f"jdbc:{name}:{u.path}", "dbtable": table, "driver": driver} | asked
    verify = "disable" if insecure else "verify-full" if ca else "require"
    tls = {"mysql": {"disable": "sslMode=DISABLED", "require": "sslMode=REQUIRED", "verify-full": "sslMode=VERIFY_IDENTITY"}, "postgresql": {k: f"sslmode={k}" for k in ("disable", "require", "verify-full")}}[name][verify]
    out = {"url": f"jdbc:{name}://{u.hostname}{f':{u.port}' if u.port else ''}{u.path}?{tls}", "dbtable": table, "driver": driver}
    out |= {k: v for k, v in (("user", u.username), ("password", u.password)) if v}
    return out | asked


def read_jdbc(
    spark: SparkSession, url: str, tables: dict[str, str], since: date | None = None, physical: dict[str, dict[str, str]] | None = None, **tls: object
) -> dict[str, DataFrame]:
    """Tables of a database under their logical names.

    The address may say how transactions are read in parts (``SPLIT``); the smaller tables are read in one.
    ``physical`` has the columns' names in the database by table and logical name, where they differ. ``since`` and
    later conditions and column choices are pushed to the source.
    """
    out = {}
    for name, table in tables.items():
        options = jdbc_options(url, table, **tls)
        if name != "transaction":
            options = {k: v for k, v in options.items() if k not in SPLIT}
        out[name] = renamed(spark.read.format("jdbc").options(**options).load(), (physical or {}).get(name, {}))
    if since is not None:
        out["transaction"] = newer(out["transaction"], since)
    return out


def newer(transactions: DataFrame, since: date) -> DataFrame:
    return transactions.filter(F.col("transaction_date") >= F.lit(since).cast("timestamp_ntz"))


def validated(spark: SparkSession, found: dict[str, DataFrame], schemas: dict | None = None) -> DataFrame:
    """(table, column, problem): all missing tables and columns at once, names compared in any case; schemas only."""
    rows = []
    for name, schema in (schemas or SCHEMAS).items():
        if name not in found:
            rows.append((name, None, "missing table"))
            continue
        have = {c.lower() for c in found[name].columns}
        rows += [(name, f.name, "missing column") for f in schema if f.name.lower() not in have]
    return spark.createDataFrame(rows, "table string, column string, problem string")


def land(tables: dict[str, DataFrame], folder: str, limit: int | None = None) -> dict[str, int]:
    """Tables written as Parquet and how many rows each has, counted as they are written; a source without transactions is refused beforehand."""
    if tables["transaction"].isEmpty():
        raise ValueError("the source has no transactions")
    counts = {}
    for name, df in tables.items():
        df = df.limit(limit) if limit and name == "transaction" else df
        seen = Observation()
        df.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        counts[name] = seen.get["rows"]
    return counts


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    if kind == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def snapshot(df: DataFrame, limit: int = 200) -> DataFrame:
    """The first rows as JSON texts; NaN becomes null."""
    clean = {f.name: F.nanvl(f.name, F.lit(None).cast(f.dataType)) for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.limit(limit).withColumns(clean).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def fingerprint(alias_version: int, pepper: str | None = None) -> str:
    """Changes with the declared schemas, the alias table's version or the pepper of blind indexes."""
    spec = {k: v.jsonValue() for k, v in SCHEMAS.items()} | {"aliases": alias_version}
    if pepper:
        spec["blind"] = hmac.new(pepper.encode(), b"fingerprint", hashlib.sha256).hexdigest()
    return hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()[:16]
