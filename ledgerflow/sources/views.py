"""Canonical transactions and related inputs, as views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.taxonomy import EXPENSE_CATEGORIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions: user, id, time, exact amount, direction, category, merchant and flags.

    The fact table joins three dimensions by key; Spark picks the join by their sizes at run time.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    d = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    categories = F.array(*[F.lit(c) for c in EXPENSE_CATEGORIES])
    credit = F.col("l_returnflag") == "R"
    style = F.col("l_linenumber") % 4
    merchant = (
        F.when(style == 0, F.col("s_name"))
        .when(style == 1, F.concat_ws("/", F.lit("UPI"), "s_name", F.col("l_orderkey").cast("string")))
        .when(style == 2, F.concat(F.lit("POS "), F.col("s_name")))
        .otherwise(F.concat(F.col("s_name"), F.lit(" #"), F.col("l_orderkey").cast("string")))
    )
    return d.select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(cast(l_shipdate as date) as string))").alias("transaction_id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.expr("cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(18,2))").alias("amount"),
        F.when(credit, "credit").otherwise("debit").alias("direction"),
        F.when(credit, "income").otherwise(F.element_at(categories, ((F.substring("p_brand", 7, 9).cast("int") - 1) % 11 + 1).cast("int"))).alias("category"),
        merchant.alias("merchant_raw"),
        F.regexp_replace(F.lower(F.trim(merchant)), "[^a-z0-9]", "_").alias("merchant_key"),
        F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("description"),
        (F.col("l_linenumber") == 1).alias("is_recurring"),
    )


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-day transactions of one month, from the event stream's table."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("user_id"), F.col("event_id").cast("string").alias("transaction_id"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").cast("decimal(18,2)").alias("amount"), F.when(F.col("event_type") == "signup", "credit").otherwise("debit").alias("direction"),
        F.col("event_type").alias("category"), F.concat(F.lit("m"), F.get_json_object("props", "$.k")).alias("merchant_raw"),
    )


_LIST = "[" + ", ".join(f"'{c}'" for c in EXPENSE_CATEGORIES) + "]"
#: The same views as common table expressions for SQL.
TX = f"""txns AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS transaction_id,
    CAST(l_shipdate AS TIMESTAMP) AS timestamp,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS amount,
    CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS direction,
    CASE WHEN l_returnflag = 'R' THEN 'income' ELSE ({_LIST})[(CAST(substr(p_brand, 7) AS INT) - 1) % 11 + 1] END AS category,
    CASE l_linenumber % 4 WHEN 0 THEN s_name WHEN 1 THEN concat_ws('/', 'UPI', s_name, l_orderkey) WHEN 2 THEN 'POS ' || s_name ELSE s_name || ' #' || l_orderkey END AS merchant_raw,
    regexp_replace(lower(CASE l_linenumber % 4 WHEN 0 THEN s_name WHEN 1 THEN concat_ws('/', 'UPI', s_name, l_orderkey) WHEN 2 THEN 'POS ' || s_name ELSE s_name || ' #' || l_orderkey END), '[^a-z0-9]', '_', 'g') AS merchant_key,
    concat_ws(' ', p_type, p_name, p_brand) AS description, l_linenumber = 1 AS is_recurring
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
EV = """evs AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS transaction_id, CAST(ts AS TIMESTAMP) AS timestamp, CAST(value AS DECIMAL(18,2)) AS amount,
    CASE WHEN event_type = 'signup' THEN 'credit' ELSE 'debit' END AS direction, event_type AS category, 'm' || json_extract_string(props, '$.k') AS merchant_raw FROM events)"""
