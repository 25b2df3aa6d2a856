"""Datasets derived from the given tables.

Each fixture is a Spark DataFrame built from the given tables, so its size
grows with them, plus the same definition as SQL text that DuckDB can run
(used as a CTE by the oracle queries).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# ---------------------------------------------------------------------------
# order_features: the regression dataset (one row per order).
# Line items are aggregated per order *before* the join with orders, so the
# big join shuffles one row per order instead of one per line.
# ---------------------------------------------------------------------------

ORDER_FEATURES_SQL = """
select o.o_orderkey as id, o.o_totalprice as response, a.n_lines, a.sum_qty, a.avg_disc,
       a.avg_tax, a.sum_ext, a.max_ext, a.max_size, a.avg_retail, a.min_qty
from orders o join (
  select l_orderkey, cast(count(*) as double) as n_lines, sum(l_quantity) as sum_qty,
         round(avg(l_discount), 6) as avg_disc, round(avg(l_tax), 6) as avg_tax,
         round(sum(l_extendedprice), 2) as sum_ext, max(l_extendedprice) as max_ext,
         cast(max(p_size) as double) as max_size, round(avg(p_retailprice), 4) as avg_retail,
         min(l_quantity) as min_qty
  from lineitem join part on l_partkey = p_partkey
  group by l_orderkey) a on a.l_orderkey = o.o_orderkey
"""

FEATURES = ["n_lines", "sum_qty", "avg_disc", "avg_tax", "sum_ext", "max_ext",
            "max_size", "avg_retail", "min_qty"]


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity",
                                                   "l_discount", "l_tax", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    per_order = (
        li.join(part, li.l_partkey == part.p_partkey)
        .groupBy("l_orderkey")
        .agg(F.count(F.lit(1)).cast("double").alias("n_lines"),
             F.sum("l_quantity").alias("sum_qty"),
             F.round(F.avg("l_discount"), 6).alias("avg_disc"),
             F.round(F.avg("l_tax"), 6).alias("avg_tax"),
             F.round(F.sum("l_extendedprice"), 2).alias("sum_ext"),
             F.max("l_extendedprice").alias("max_ext"),
             F.max("p_size").cast("double").alias("max_size"),
             F.round(F.avg("p_retailprice"), 4).alias("avg_retail"),
             F.min("l_quantity").alias("min_qty"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return (orders.join(per_order, orders.o_orderkey == per_order.l_orderkey)
            .select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("response"),
                    *FEATURES))


# ---------------------------------------------------------------------------
# dag_frame: line items under the column names of the preprocessing example.
# ---------------------------------------------------------------------------

DAG_FRAME_SQL = """
select l_orderkey, l_linenumber, l_quantity as x1, l_discount as x2, l_extendedprice as x3,
       l_tax as x4, cast(l_suppkey as double) as x5
from lineitem
"""


def dag_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"),
                     F.col("l_extendedprice").alias("x3"), F.col("l_tax").alias("x4"),
                     F.col("l_suppkey").cast("double").alias("x5"))


# ---------------------------------------------------------------------------
# Metadata (base_id, name, value, seq): every event is one metadata write of
# its user (base), named by event type; seq orders the writes.
# ---------------------------------------------------------------------------

METADATA_LOG_SQL = """
select user_id as base_id, event_type as name, value, event_id as seq, ts from events
"""


def metadata_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("base_id"), F.col("event_type").alias("name"),
                     "value", F.col("event_id").alias("seq"), "ts")


METADATA_SQL = """
select base_id, name, arg_max(value, seq) as value, max(seq) as seq
from (""" + METADATA_LOG_SQL + """) group by base_id, name
"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata table: unique (base_id, name), last write wins."""
    return (metadata_log(spark, sf_dir).groupBy("base_id", "name")
            .agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")))


# ---------------------------------------------------------------------------
# Registry stand-ins: model -> workflow -> location -> owner is
# orders -> customer -> nation -> region.  A model "has a fitted artifact"
# when its order status is 'F'.
# ---------------------------------------------------------------------------

def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("model_id"), F.col("o_custkey").alias("workflow_id"),
                    (F.col("o_orderstatus") == "F").alias("fitted"))


MODELS_SQL = """
select o_orderkey as model_id, o_custkey as workflow_id, o_orderstatus = 'F' as fitted from orders
"""


def workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("workflow_id"), F.col("c_nationkey").cast("bigint").alias("location_id"),
                    F.col("c_name").alias("name"))


WORKFLOWS_SQL = """
select c_custkey as workflow_id, cast(c_nationkey as bigint) as location_id, c_name as name from customer
"""


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("location_id"),
                    F.col("n_regionkey").cast("bigint").alias("owner_id"),
                    F.col("n_name").alias("name"))


LOCATIONS_SQL = """
select cast(n_nationkey as bigint) as location_id, cast(n_regionkey as bigint) as owner_id, n_name as name from nation
"""


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").cast("bigint").alias("owner_id"), F.col("r_name").alias("name"))


OWNERS_SQL = """
select cast(r_regionkey as bigint) as owner_id, r_name as name from region
"""

# The other tables of the registry.  Datasets are parts, in the workflow of the
# customer with key p_partkey mod 100; what hangs on models are line items, what
# hangs on workflows and datasets are events, line items and suppliers.
REGISTRY_SQL = {
    "user": "select cast(r_regionkey as bigint) as user_id from region",
    "location": LOCATIONS_SQL,
    "workflow": WORKFLOWS_SQL,
    "analytical_model": MODELS_SQL,
    "dataset": "select p_partkey as dataset_id, p_partkey % 100 as workflow_id, p_name as name, p_type as data from part",
    "location_metadata": "select cast(s_nationkey as bigint) as base_id, s_name as name, s_acctbal as value from supplier",
    "workflow_results": "select l_suppkey as workflow_id, l_partkey as dataset_id, l_shipdate as timestamp from lineitem",
    "preprocessing_config": "select user_id as workflow_id, event_type as name, props as config from events",
    "model_metadata": "select l_orderkey as base_id, l_returnflag as name, l_tax as value from lineitem",
    "model_data": "select l_orderkey as model_id, l_partkey as dataset, l_linestatus as name from lineitem",
    "model_results": "select l_orderkey as model_id, l_partkey as dataset, l_extendedprice as result from lineitem",
    "dataset_metadata": "select l_partkey as base_id, l_linestatus as name, l_quantity as value from lineitem",
    "access_control_list": "select event_id % 7 as owner_id, user_id % 11 as target_user_id, event_id as object_id, event_type as object_type from events",
}


def registry(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All registry tables, from the same SQL as the oracles."""
    names = ("region", "nation", "customer", "orders", "part", "supplier", "lineitem", "events")
    return {t: spark.sql(re.sub(r"\bfrom (\w+)", lambda m: "from {" + m.group(1) + "}" if m.group(1) in names else m.group(0), q),
                         **{n: table(spark, sf_dir, n) for n in names if re.search(rf"\bfrom {n}\b", q)})
            for t, q in REGISTRY_SQL.items()}


# Grant requests on objects of all four types, by event_id mod 4.
OBJECT_REQUESTS_SQL = """
select event_id as request_id, cast(event_id % 5 as bigint) as grantor_id, user_id as target_user_id,
       case event_id % 4 when 0 then 'Location' when 1 then 'Workflow' when 2 then 'Dataset' else 'AnalyticalModel' end as object_type,
       cast(case event_id % 4 when 0 then user_id % 25 when 1 then user_id % 40 when 2 then user_id % 60 else user_id % 80 end as bigint) as object_id,
       ts, case when event_type = 'view' then 'READ' else 'WRITE' end as access_type
from events
"""


def object_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OBJECT_REQUESTS_SQL.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))


# Grant requests: every event asks to grant its user access to one location.
# Fixed derivation rules: grantor = event_id mod 5, location = user_id mod 25,
# expiry = ts + 7 days, access 'READ' for view events else 'WRITE'.
GRANT_REQUESTS_SQL = """
select event_id as request_id, cast(event_id % 5 as bigint) as grantor_id, user_id as target_user_id,
       'Location' as object_type, cast(user_id % 25 as bigint) as object_id,
       ts + interval 7 day as expiration,
       case when event_type = 'view' then 'READ' else 'WRITE' end as access_type, ts
from events
"""


def grant_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.pmod("event_id", F.lit(5)).cast("bigint").alias("grantor_id"),
        F.col("user_id").alias("target_user_id"),
        F.lit("Location").alias("object_type"),
        F.pmod("user_id", F.lit(25)).cast("bigint").alias("object_id"),
        (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expiration"),
        F.when(F.col("event_type") == "view", "READ").otherwise("WRITE").alias("access_type"),
        "ts")


# Run log: every event is a status write for model user_id; stage n/6 from
# event_id mod 7, '-1/6' for error events (the failure form).
RUN_LOG_SQL = """
select user_id as model_id, ts,
       case when event_type = 'error' then 'failed'
            when event_id % 7 = 6 then 'done' else 'active' end as status,
       case when event_type = 'error' then '-1/6' else cast(event_id % 7 as varchar) || '/6' end as stage,
       case when event_type = 'error' then 'no usable rows' else null end as message,
       event_id
from events
"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    err = F.col("event_type") == "error"
    step = F.pmod("event_id", F.lit(7))
    return ev.select(
        F.col("user_id").alias("model_id"), "ts",
        F.when(err, "failed").when(step == 6, "done").otherwise("active").alias("status"),
        F.when(err, "-1/6").otherwise(F.concat(step.cast("string"), F.lit("/6"))).alias("stage"),
        F.when(err, F.lit("no usable rows")).otherwise(F.lit(None).cast("string")).alias("message"),
        "event_id")
