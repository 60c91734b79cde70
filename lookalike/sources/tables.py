"""Entity tables derived from the driver's star schema.

Every view is a lazy DataFrame plan over the parquet scans, so Catalyst prunes
columns and pushes filters into the scan.  Orders are aggregated per customer
*before* the join (map-side partial aggregation, one shuffle on the customer key);
the customer spine is then left-joined so that entities without orders survive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.sources.readers import read_table


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("long").alias("entity_id"),
        F.col("c_nationkey").alias("region"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").cast("double").alias("acctbal"),
    )


def entity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, region, segment, name + six numeric features per customer."""
    orders = read_table(spark, sf_dir, "orders")
    per_customer = orders.groupBy(F.col("o_custkey").alias("entity_id")).agg(
        F.count("o_orderkey").cast("double").alias("n_orders"),
        F.sum("o_totalprice").alias("total"),
        F.avg("o_totalprice").alias("avg_total"),
        F.max("o_totalprice").alias("max_total"),
        F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("double").alias("n_status_f"),
    )
    out = customers(spark, sf_dir).join(per_customer, "entity_id", "left")
    # a customer without orders has spent nothing: every order measure is 0, never NULL
    zero = F.lit(0.0)
    return out.select(
        "entity_id", "region", "segment", "name", "acctbal",
        *[F.coalesce(c, zero).alias(c) for c in ("n_orders", "total", "avg_total", "max_total", "n_status_f")],
    )


ENTITY_FEATURES = ["acctbal", "n_orders", "total", "avg_total", "max_total", "n_status_f"]

# How each pivot names its columns (prefix + key).
PIVOTS = {
    "status": ("status_", lambda: F.col("o_orderstatus")),
    "priority": ("prio_", lambda: F.substring("o_orderpriority", 1, 1)),
    "year": ("y", lambda: F.year("o_orderdate").cast("string")),
    "quarter": ("q", lambda: F.concat(F.year("o_orderdate").cast("string"), F.lit("_"),
                                      F.quarter("o_orderdate").cast("string"))),
    "month": ("m", lambda: F.date_format("o_orderdate", "yyyyMM")),
}


def entity_pivot(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """entity_id, region, segment + avg(o_totalprice) per pivot key; NULL where a customer has no order."""
    prefix, key_fn = PIVOTS[by]
    key = key_fn()
    orders = read_table(spark, sf_dir, "orders")
    keyed = orders.select(F.col("o_custkey").alias("entity_id"), key.alias("k"), "o_totalprice")
    # Distinct pivot values are a small, calendar-bounded set: collect them once so the
    # pivot runs as a single aggregation with a fixed output schema.
    values = sorted(r["k"] for r in keyed.select("k").distinct().collect())
    wide = keyed.groupBy("entity_id").pivot("k", values).agg(F.avg("o_totalprice"))
    wide = wide.select("entity_id", *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])
    spine = customers(spark, sf_dir).select("entity_id", "region", "segment")
    return spine.join(wide, "entity_id", "left")


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("entity_id"),
        F.col("l_returnflag").alias("region"),
        F.col("l_linestatus").alias("segment"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )


LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: line count and sums of quantity, price, revenue, charge and gross price
    (four nearly collinear money measures), plus the mean discount."""
    li = read_table(spark, sf_dir, "lineitem")
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return li.groupBy(F.col("l_orderkey").cast("long").alias("entity_id")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
        F.sum(price).alias("sum_price"), F.sum(price * (1 - disc)).alias("sum_revenue"),
        F.sum(price * (1 - disc) * (1 + tax)).alias("sum_charge"), F.sum(price * (1 + tax)).alias("sum_gross"),
        F.avg(disc).alias("avg_disc"))


ORDER_LINE_FEATURES = ["n_lines", "sum_qty", "sum_price", "sum_revenue", "sum_charge", "sum_gross", "avg_disc"]


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").cast("long").alias("entity_id"),
                     F.col("event_type").alias("region"), F.col("value").cast("double").alias("value"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, region (label), segment (a fixed integer rule), features array<double>."""
    em = read_table(spark, sf_dir, "embeddings")
    return em.select(
        F.col("vec_id").cast("long").alias("entity_id"),
        F.col("label").alias("region"),
        F.pmod(F.col("vec_id"), F.lit(4)).cast("int").alias("segment"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
    )


def vector_columns(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    """The embedding array spread into columns d0..d{n-1} (for wide-table operators)."""
    v = vectors(spark, sf_dir)
    if dims is None:
        dims = v.select(F.size("features").alias("n")).first()["n"]
    return v.select("entity_id", "region", "segment",
                    *[F.col("features")[i].alias(f"d{i}") for i in range(dims)])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = read_table(spark, sf_dir, "embeddings")
    return em.select(F.col("vec_id").cast("long").alias("entity_id"),
                     F.col("label").cast("int").alias("label"),
                     F.pmod(F.col("vec_id"), F.lit(10)).cast("int").alias("prediction"))
