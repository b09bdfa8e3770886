"""The ledger's tables: declared schemas, and a view of the driver's star schema as a ledger.

bank: market segments; account: customers, a nation being the entity; transaction: orders, with a narration made from
a rail template, a part as the counterparty, which gives names in proportion to the parts, and digits of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(15, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


S, D = T.StringType(), T.DateType()
SCHEMAS = {
    "bank": _schema(bank_code=S, bank_name=S),
    "account": _schema(account_id=S, entity_id=S, account_number=S, program_id=T.IntegerType(), available_balance=MONEY, bank_code=S),
    "transaction": _schema(
        transaction_id=S, account_id=S, transaction_date=T.TimestampNTZType(), transaction_type=S, description=S,
        transaction_amount=MONEY, transaction_reference_id=S, utr_number=S,
    ),
}
#: The vendor-payout files of the older form of the ledger.
PAYOUT_SCHEMAS = {
    "vendor_list": _schema(vendor_id=S, vendor_name=S, category=S),
    "chart_of_accounts": _schema(account_id=S, account_name=S, account_type=S),
    "vendor_payouts": _schema(payout_id=S, payout_date=D, vendor_id=S, amount=MONEY, currency=S, status=S, description=S),
    "transactions": _schema(
        transaction_id=S, transaction_date=D, vendor_id=S, account_id=S, amount=MONEY, transaction_type=S, payout_id=S, description=S
    ),
    "reconciliation_status": _schema(transaction_id=S, reconciliation_status=S, reconciled_date=D, notes=S),
}

#: Narration of an order ``h`` with part name ``p``, segment ``s`` and bucket ``b``: plain SQL on both engines.
NARRATION = """
CASE WHEN b < 70 THEN
  CASE h % 6
    WHEN 0 THEN 'UPI-' || upper(p) || sfx || '-XXXXXX' || CAST(h % 10000 AS STRING) || '-' || s || '000' || CAST(h % 9999 AS STRING) || '-' || CAST(500000000000 + h AS STRING)
    WHEN 1 THEN 'NEFT  - ' || s || '000' || CAST(h % 9999 AS STRING) || ' - ' || CAST(95000000 + h AS STRING) || ' - ' || upper(p) || sfx
    WHEN 2 THEN 'IMPS/P2A/' || CAST(600000000000 + h AS STRING) || '/' || s || '/' || CAST(918020101986700 + h AS STRING) || '/00/INET/' || CAST(h % 9999 AS STRING) || '/' || upper(p) || '/ZB' || CAST(h % 99999 AS STRING) || '/INWD48'
    WHEN 3 THEN 'FT -  ' || CAST(95000000 + h AS STRING) || ' -  ' || CAST(50200013729069 + h AS STRING) || ' - ' || upper(p) || '   VIMAN NAGAR'
    WHEN 4 THEN 'R/' || s || 'R5' || CAST(h % 999999 AS STRING) || '/ZB4' || CAST(h % 99999 AS STRING) || '//' || upper(p) || sfx || '/REF' || CAST(h % 9999 AS STRING)
    ELSE 'NEFT/' || CAST(h % 999999999 AS STRING) || '/' || s || '/' || upper(p) || sfx END
WHEN b < 80 THEN 'UPI-' || CASE h % 7 WHEN 0 THEN 'BUNDL TECHNOLOGIES' WHEN 1 THEN 'SWIGGY' WHEN 2 THEN 'SWIGY' WHEN 3 THEN 'AMAZON SELLER SERVICES'
  WHEN 4 THEN 'Zomato Private Limited' WHEN 5 THEN 'ETERNAL' ELSE 'FOO INDIA PVT LTD' END || '-XXXXXX' || CAST(h % 10000 AS STRING) || '-' || s || '0002125'
WHEN b < 89 THEN CASE h % 2
    WHEN 0 THEN 'IMPS OW/' || CAST(500000000000 + h AS STRING) || '/' || upper(substr(p, 1, 1)) || substr(p, 2) || ' Roy/' || s || '/' || CAST(43292707719 + h AS STRING)
    ELSE 'NEFT/' || CAST(h % 999999999 AS STRING) || '/' || s || '/' || upper(substr(p, 1, 1)) || substr(p, 2) || ' Roy' END
WHEN b < 92 THEN CASE h % 3 WHEN 0 THEN 'IMPS charges' WHEN 1 THEN 'SMS ALERT 4' ELSE 'UPI-PREPAID RECHARGE-XXXXXX' || CAST(h % 100 AS STRING) END
WHEN b < 94 THEN 'FT - SELF - ' || CAST(50200013729069 + h AS STRING) || ' - SELF TRANSFER'
ELSE 'TRF/' || CAST(h * 31 AS STRING) || '/' || CAST(h * 17 AS STRING) END
"""

#: Orders with their part's name, the segment of their customer, and the numbers that the templates use.
_ORDERS = """
SELECT o_orderkey AS h, o_custkey, o_orderdate, o_orderstatus, o_totalprice, p, c_mktsegment AS s, (o_orderkey * 79) % 100 AS b,
       CASE o_orderkey % 4 WHEN 1 THEN ' LIMITED' WHEN 2 THEN ' PVT LTD' ELSE '' END AS sfx
FROM {orders} CROSS JOIN (SELECT count(*) AS n_parts FROM {part}) JOIN {named} ON p_partkey = o_orderkey % n_parts JOIN {customer} ON c_custkey = o_custkey
"""
#: Parts with a name of their own each: that of the table, which has few, and a word made from the key.
_NAMED = "SELECT p_partkey, p_name || ' ' || translate(substr(md5(CAST(p_partkey AS STRING)), 1, 12), '0123456789', 'ghijklmnop') AS p FROM {part}"
_TRANSACTION = f"""
SELECT CAST(h AS STRING) AS transaction_id, CAST(o_custkey AS STRING) AS account_id, o_orderdate AS transaction_date,
       CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END AS transaction_type, {NARRATION} AS description,
       CAST(o_totalprice AS DECIMAL(15,2)) AS transaction_amount,
       CASE WHEN h % 11 <> 0 THEN 'REF' || CAST(h % 5000 AS STRING) END AS transaction_reference_id,
       CASE WHEN h % 3 <> 0 THEN 'UTR' || CAST(100000 + h AS STRING) END AS utr_number
FROM {{joined}}
"""
_ACCOUNT = """
SELECT CAST(c_custkey AS STRING) AS account_id, CAST(c_nationkey AS STRING) AS entity_id, c_name AS account_number,
       CAST(CASE c_custkey % 3 WHEN 0 THEN 21 WHEN 1 THEN 4 ELSE 46 END AS INT) AS program_id,
       CAST(c_acctbal AS DECIMAL(15,2)) AS available_balance, c_mktsegment AS bank_code
FROM {customer}
"""
_BANK = "SELECT DISTINCT c_mktsegment AS bank_code, c_mktsegment || ' BANK' AS bank_name FROM {customer}"

#: The same view as common table expressions for DuckDB.
ORACLE = ",\n".join(
    [
        f"named AS ({_NAMED.format(part='part')})",
        f"ordered AS ({_ORDERS.format(orders='orders', part='part', named='named', customer='customer')})",
        f"txn AS ({_TRANSACTION.format(joined='ordered')})",
        f"account AS ({_ACCOUNT.format(customer='customer')})",
        f"bank AS ({_BANK.format(customer='customer')})",
    ]
)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a table's files over all cores, where the files have fewer splits than there are cores."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.isStreaming or rows.rdd.getNumPartitions() >= n else rows.repartition(n)


def named_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, p): the counterparties' names."""
    return spark.sql(_NAMED, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def read(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """bank, account and transaction as views of the driver's tables."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "part", "customer")}
    joined = spark.sql(_ORDERS, orders=spread(t["orders"]), part=t["part"], named=named_parts(spark, sf_dir), customer=t["customer"])
    return {
        "bank": spark.sql(_BANK, customer=t["customer"]),
        "account": spark.sql(_ACCOUNT, customer=t["customer"]),
        "transaction": spark.sql(_TRANSACTION, joined=joined),
    }


def renamed(df: DataFrame, physical: dict[str, str]) -> DataFrame:
    """``df`` with its physical column names replaced by the logical ones."""
    return df.withColumnsRenamed({v: k for k, v in physical.items()})


#: The five files of vendor payouts made from orders, suppliers and nations: plain SQL on both engines.
PAYOUT_FILES = {
    "vendor_list": "SELECT 'V' || CAST(s_suppkey AS STRING) AS vendor_id, s_name || ', \"' || s_name || '\" Ltd' AS vendor_name, 'nation ' || CAST(s_nationkey AS STRING) AS category FROM {supplier}",
    "chart_of_accounts": "SELECT 'A' || CAST(n_nationkey AS STRING) AS account_id, n_name AS account_name, 'Expense' AS account_type FROM {nation}",
    "vendor_payouts": """SELECT 'P' || CAST(o_orderkey AS STRING) AS payout_id, CAST(o_orderdate AS DATE) AS payout_date, 'V' || CAST(o_orderkey % n_suppliers AS STRING) AS vendor_id,
        CAST(o_totalprice AS DECIMAL(15,2)) AS amount, 'INR' AS currency, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Pending' ELSE 'Failed' END AS status, o_orderpriority || ', paid' AS description
        FROM {orders} CROSS JOIN (SELECT count(*) AS n_suppliers FROM {supplier}) WHERE o_orderkey % 3 <> 0""",
    "transactions": """SELECT 'T' || CAST(o_orderkey AS STRING) AS transaction_id, CAST(o_orderdate AS DATE) AS transaction_date, 'V' || CAST(o_orderkey % n_suppliers AS STRING) AS vendor_id,
        'A' || CAST(o_custkey % 25 AS STRING) AS account_id, CAST(o_totalprice AS DECIMAL(15,2)) AS amount, 'Debit' AS transaction_type,
        CASE WHEN o_orderkey % 3 <> 0 THEN 'P' || CAST(o_orderkey AS STRING) END AS payout_id, o_orderpriority AS description
        FROM {orders} CROSS JOIN (SELECT count(*) AS n_suppliers FROM {supplier})""",
    "reconciliation_status": """SELECT 'T' || CAST(o_orderkey AS STRING) AS transaction_id, CASE o_orderkey % 4 WHEN 0 THEN 'Reconciled' WHEN 1 THEN 'Unreconciled' WHEN 2 THEN 'Pending' ELSE 'Disputed' END AS reconciliation_status,
        CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS reconciled_date, 'order ' || CAST(o_orderkey AS STRING) || ', ' || o_orderpriority AS notes FROM {orders}""",
}
PAYOUT_FILES_ORACLE = ",\n".join(f"{name} AS ({text.format(supplier='supplier', nation='nation', orders='orders')})" for name, text in PAYOUT_FILES.items())


def write_payout_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The five files as CSV in ``folder``, each in parts."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("supplier", "nation", "orders")}
    for name, text in PAYOUT_FILES.items():
        spark.sql(text, **{k: v for k, v in t.items() if f"{{{k}}}" in text}).write.csv(f"{folder}/{name}.csv", header=True, escape='"')


def payouts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Vendors, payouts and reconciliation as views of suppliers and line items."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    lines, vendors = read("lineitem"), read("supplier").select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"))
    parts = read("part").select("p_partkey", F.col("p_type").alias("category"))
    status = F.when(F.col("l_returnflag") == "R", "Failed").when(F.col("l_linestatus") == "O", "Pending").otherwise("Completed")
    rows = lines.select(
        F.col("l_orderkey").alias("payout_key"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p_partkey"),
        F.col("l_suppkey").alias("vendor_id"), F.col("l_shipdate").cast("date").alias("payout_date"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"), status.alias("status"),
        F.when(F.col("l_returnflag") == "A", "Reconciled").when(F.col("l_returnflag") == "N", "Unreconciled").otherwise("Disputed").alias("reconciliation_status"),
    )
    return {"vendors": vendors, "payouts": rows.join(parts, "p_partkey").drop("p_partkey")}


#: The payout view for DuckDB.
PAYOUTS_ORACLE = """
vendors AS (SELECT s_suppkey AS vendor_id, s_name AS vendor_name FROM supplier),
payouts AS (SELECT l_orderkey AS payout_key, l_linenumber AS line, l_suppkey AS vendor_id, CAST(l_shipdate AS DATE) AS payout_date,
                   CAST(l_extendedprice AS DECIMAL(15,2)) AS amount,
                   CASE WHEN l_returnflag = 'R' THEN 'Failed' WHEN l_linestatus = 'O' THEN 'Pending' ELSE 'Completed' END AS status,
                   CASE l_returnflag WHEN 'A' THEN 'Reconciled' WHEN 'N' THEN 'Unreconciled' ELSE 'Disputed' END AS reconciliation_status,
                   p_type AS category
            FROM lineitem JOIN part ON p_partkey = l_partkey)
"""
