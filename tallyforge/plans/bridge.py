"""Ledger inputs from the driver's tables: one SQL text that Spark and the oracle both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FACT = """
select cast(o_orderkey as bigint) as n, concat('acct-', cast(o_custkey % 30 as string)) as account_ref, cast(o_orderdate as date) as date,
  cast((case when o_custkey % 2 = 0 then -1 else 1 end) * (1 + o_orderkey % 400) * 100 as bigint) as amount,
  concat('MERCHANT ', cast(o_custkey % 40 as string), ' ', substr(o_orderpriority, 3), case when o_orderkey % 3 = 0 then '   SYDNEY' when o_orderkey % 3 = 1 then ' - Visa Purchase' else '' end) as raw_description,
  case when o_orderkey % 5 = 0 then cast(o_orderkey % 400 as string) end as receipt,
  case when o_orderstatus = 'P' and o_orderkey % 4 = 0 then 'pending' else 'posted' end as observation
from orders
"""
SERIES = """
select cast(1000000 + c_custkey * 100 + n_nationkey as bigint) as n, concat('acct-', cast(c_custkey % 30 as string)) as account_ref,
  cast(case when c_custkey % 3 = 0 then cast(date '2022-01-31' + interval '1' month * n_nationkey as date)
            when c_custkey % 3 = 1 then date '2022-03-01' + n_nationkey * 7
            else cast(date '2022-02-15' + interval '1' month * (3 * n_nationkey) as date) end as date)
    + (case when c_custkey % 5 = 0 then n_nationkey % 2 else 0 end) as date,
  cast(-(500 + c_custkey % 50 * 10 + case when n_nationkey >= 12 then 200 else 0 end) as bigint) as amount,
  concat('SERIES ', cast(c_custkey as string), ' - Visa Purchase') as raw_description
from customer cross join nation where c_custkey % 10 < 6
"""
#: The driver's rows as statement rows with a running balance that breaks now and then.
BALANCED = f"select f.*, sum(amount) over (partition by account_ref order by date, n) + case when n % 997 = 0 then 1 else 0 end as balance from ({FACT}) f"


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "orders")
    return spark.sql(FACT)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "customer", "nation")
    return spark.sql(SERIES)


def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "orders")
    return spark.sql(BALANCED)
