"""Readers of the text formats of the workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TPCH = {
    "customer": "c_custkey INT, c_name STRING, c_address STRING, c_nationkey INT, c_phone STRING, c_acctbal DOUBLE, c_mktsegment STRING, c_comment STRING",
    "lineitem": "l_orderkey INT, l_partkey INT, l_suppkey INT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate STRING, l_commitdate STRING, l_receiptdate STRING, l_shipinstruct STRING, l_shipmode STRING, l_comment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT, n_comment STRING",
    "orders": "o_orderkey INT, o_custkey INT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate STRING, o_orderpriority STRING, o_clerk STRING, o_shippriority INT, o_comment STRING",
    "part": "p_partkey INT, p_name STRING, p_mfgr STRING, p_brand STRING, p_type STRING, p_size INT, p_container STRING, p_retailprice DOUBLE, p_comment STRING",
    "partsupp": "ps_partkey INT, ps_suppkey INT, ps_availqty INT, ps_supplycost DOUBLE, ps_comment STRING",
    "region": "r_regionkey INT, r_name STRING, r_comment STRING",
    "supplier": "s_suppkey INT, s_name STRING, s_address STRING, s_nationkey INT, s_phone STRING, s_acctbal DOUBLE, s_comment STRING",
}


def read_tbl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of |-separated lines; the bar at the end of a line is not a field."""
    kind = T.StructType.fromDDL(schema)
    whole = T.StructType([*kind.fields, T.StructField("__end", T.StringType())])
    return spark.read.csv(path, sep="|", schema=whole).drop("__end")


def read_vectors(spark: SparkSession, path: str, column: str = "x") -> DataFrame:
    """One array of doubles for each line of numbers between blanks or commas; empty lines are left out."""
    parts = F.filter(F.split(F.trim("value"), r"[\s,]+"), lambda x: x != "")
    return spark.read.text(path).where(F.trim("value") != "").select(F.transform(parts, lambda x: x.cast("double")).alias(column))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, word_id, n) from lines of three integers."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(*[p.getItem(i).cast("int").alias(c) for i, c in enumerate(("doc_id", "word_id", "n"))])


def nested_customers(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, supplier: DataFrame, part: DataFrame, copies: int = 1, fields: tuple[str, ...] | None = None) -> DataFrame:
    """All customers, with their orders, which hold their lines with supplier and part (an empty array where there are none); a copy number makes replicas.

    With `fields` objects have no other fields. Every object stays; a supplier or part without any of them keeps its key.
    """

    def held_of(key: str, *names: str) -> Column:
        kept = [n for n in names if fields is None or n in fields]
        return F.struct(*(kept or [key]))

    lines = (
        lineitem.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), held_of("s_suppkey", "s_suppkey", "s_name").alias("supplier")), "l_suppkey")
        .join(part.select(F.col("p_partkey").alias("l_partkey"), held_of("p_partkey", "p_partkey", "p_name").alias("part")), "l_partkey")
        .select("l_orderkey", *(n for n in ("l_linenumber", "l_quantity") if fields is None or n in fields), "supplier", "part")
    )
    line = [n for n in lines.columns if n != "l_orderkey"]

    def or_none(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)))

    lines = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*line))).alias("lines"))
    order = [n for n in ("o_orderkey", "o_totalprice") if fields is None or n in fields]
    held = (
        or_none(orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left"), "lines")
        .groupBy("o_custkey")
        .agg(F.sort_array(F.collect_list(F.struct(*order, "lines"))).alias("orders"))
    )
    own = customer.columns if fields is None else [n for n in customer.columns if n in fields]
    out = or_none(customer.join(held, customer["c_custkey"] == held["o_custkey"], "left").select(*(customer[n] for n in own), "orders"), "orders")
    return out if copies == 1 else out.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
