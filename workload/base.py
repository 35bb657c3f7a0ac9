"""Proxy views and the query registry.

The test tables are a star schema; the proxy views below give them the shape of the lending
tables. Their text runs unchanged in Spark and in DuckDB. ``{name}`` stands for a test table or
another proxy view.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

AS_OF = "2001-08-01"

PROXY = {
    # Untyped text as it would land, with cells that do not convert.
    "raw_customers": """
        SELECT CAST(c_custkey AS STRING) AS customer_id,
               CASE WHEN c_custkey % 13 = 0 THEN 'abc' WHEN c_custkey % 17 = 0 THEN ''
                    ELSE CAST(18 + c_custkey % 90 AS STRING) END AS age,
               CASE WHEN c_custkey % 19 = 0 THEN '12,5' ELSE CAST(c_acctbal AS STRING) END AS amount,
               c_mktsegment AS work_type
        FROM {customer}""",
    "customer_base": """
        SELECT c_custkey AS customer_id, c_nationkey AS area_id, c_mktsegment AS work_type,
               CASE WHEN c_custkey % 11 <> 0 THEN CAST(18 + c_custkey % 90 AS INT) END AS age,
               c_custkey % 10 <> 0 AS has_mobile, c_custkey % 7 <> 0 AS has_id_card,
               c_custkey % 3 <> 0 AS has_driving_licence, c_custkey % 4 <> 0 AS has_passport,
               c_acctbal AS balance
        FROM {customer}""",
    "credit_bureau": """
        SELECT c.c_custkey AS customer_id,
               CASE WHEN c.c_custkey % 5 <> 0
                    THEN CAST(300 + (c.c_custkey * 37) % 551 AS INT) END AS credit_score,
               CAST(COALESCE(e.n, 0) AS INT) AS inquiry_cnt,
               CAST(c.c_custkey % 40 AS INT) AS credit_years
        FROM {customer} c
        LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM {events} GROUP BY user_id) e
          ON e.user_id = c.c_custkey""",
    # Orders alone; o_orderkey is unique.
    "loans": """
        SELECT o_orderkey AS loan_id, o_custkey AS customer_id,
               o_totalprice AS disbursed_amount, CAST(o_orderdate AS TIMESTAMP) AS disbursed_date,
               o_orderstatus AS product, o_orderpriority AS priority,
               CAST(12 * (1 + o_orderkey % 5) AS INT) AS term,
               CAST(o_orderkey % 41 AS DOUBLE) - 1 AS rate
        FROM {orders}""",
    # Line items are combined per order before the join: one shuffle by order key.
    "loan_history": """
        SELECT l.*, i.asset_cost, i.branch_id,
               CAST(GREATEST(COALESCE(i.returned, 0) - 3, 0) AS INT) AS overdue_cnt,
               c.c_nationkey AS area_id, c.c_mktsegment AS customer_type
        FROM {loans} l
        LEFT JOIN (SELECT l_orderkey, SUM(l_extendedprice) AS asset_cost, MIN(l_suppkey) AS branch_id,
                          SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
                   FROM {lineitem} GROUP BY l_orderkey) i ON i.l_orderkey = l.loan_id
        LEFT JOIN {customer} c ON c.c_custkey = l.customer_id""",
    "account_behavior": """
        SELECT o_custkey AS customer_id,
               CAST(SUM(pri_n) AS INT) AS pri_loan_cnt, CAST(SUM(n - pri_n) AS INT) AS sec_loan_cnt,
               CAST(SUM(pri_o) AS INT) AS pri_active_cnt, CAST(SUM(o - pri_o) AS INT) AS sec_active_cnt,
               CAST(SUM(pri_r) AS INT) AS pri_overdue_cnt, CAST(SUM(r - pri_r) AS INT) AS sec_overdue_cnt,
               SUM(outstanding) * 0.75 AS pri_outstanding, SUM(outstanding) * 0.25 AS sec_outstanding,
               SUM(approved) * 0.75 AS pri_approved, SUM(approved) * 0.25 AS sec_approved,
               SUM(disbursed) * 0.75 AS pri_disbursed, SUM(disbursed) * 0.25 AS sec_disbursed,
               SUM(approved) * 0.07 AS pri_installment, SUM(approved) * 0.02 AS sec_installment
        FROM (SELECT l_orderkey, COUNT(*) AS n,
                     SUM(CASE WHEN l_linenumber <= 4 THEN 1 ELSE 0 END) AS pri_n,
                     SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS o,
                     SUM(CASE WHEN l_linestatus = 'O' AND l_linenumber <= 4 THEN 1 ELSE 0 END) AS pri_o,
                     SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r,
                     SUM(CASE WHEN l_returnflag = 'R' AND l_linenumber <= 4 THEN 1 ELSE 0 END) AS pri_r,
                     SUM(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END) AS outstanding,
                     SUM(l_extendedprice) AS approved,
                     SUM(l_extendedprice * (1 - l_discount)) AS disbursed
              FROM {lineitem} GROUP BY l_orderkey) i
        JOIN {orders} ON o_orderkey = l_orderkey
        GROUP BY o_custkey""",
    "accounts": """
        SELECT customer_id, pri_loan_cnt + sec_loan_cnt AS loan_cnt,
               pri_active_cnt + sec_active_cnt AS active_cnt,
               pri_overdue_cnt + sec_overdue_cnt AS overdue_cnt,
               pri_outstanding + sec_outstanding AS outstanding,
               pri_approved + sec_approved AS approved,
               pri_disbursed + sec_disbursed AS disbursed,
               pri_installment + sec_installment AS installment
        FROM {account_behavior}""",
    # One row per customer with what reports and models need.
    "customers": """
        SELECT b.*, u.credit_score, u.inquiry_cnt, u.credit_years, a.loan_cnt, a.active_cnt,
               a.overdue_cnt, a.outstanding, a.approved, a.disbursed, a.installment,
               CAST(CASE WHEN CAST(a.overdue_cnt AS DOUBLE) / a.loan_cnt > CAST(0.45 AS DOUBLE)
                         THEN 1 ELSE 0 END AS INT) AS loan_default
        FROM {customer_base} b
        LEFT JOIN {credit_bureau} u ON u.customer_id = b.customer_id
        LEFT JOIN {accounts} a ON a.customer_id = b.customer_id""",
    # A stand-in for a model's probability: it follows the overdue rate, with noise and ties.
    "scored": """
        SELECT c.*, COALESCE(CAST(c.overdue_cnt AS DOUBLE) / c.loan_cnt, CAST(0 AS DOUBLE)) AS overdue_rate,
               c.disbursed AS amount,
               CAST(FLOOR(400 * COALESCE(CAST(c.overdue_cnt AS DOUBLE) / c.loan_cnt, CAST(0 AS DOUBLE)))
                    + FLOOR((c.balance + 1000) / 40) AS DOUBLE) / CAST(1000 AS DOUBLE) AS p
        FROM {customers} c""",
    "applications": """
        SELECT event_id AS application_id, user_id AS customer_id, CAST(ts AS TIMESTAMP) AS apply_time,
               event_type AS purpose, value AS amount, props
        FROM {events}""",
    "areas": """
        SELECT n_nationkey AS area_id, n_name AS area_name, r_name AS region_name,
               CAST(n_nationkey * 5 - 60 AS DOUBLE) AS latitude,
               CAST(n_nationkey * 13 - 170 AS DOUBLE) AS longitude
        FROM {nation} JOIN {region} ON r_regionkey = n_regionkey""",
    # Categories for rule mining, before discretisation.
    "repairable": """
        SELECT b.customer_id, b.work_type, b.age, b.has_mobile, b.has_id_card, b.has_passport,
               u.credit_score
        FROM {customer_base} b JOIN {credit_bureau} u ON u.customer_id = b.customer_id""",
    # The same after discretisation, as text.
    "banded": """
        SELECT customer_id, work_type,
               CASE WHEN age >= 50 THEN 'old' WHEN age >= 30 THEN 'middle' WHEN age >= 18 THEN 'young' END AS age_group,
               CASE WHEN credit_score >= 750 THEN 'excellent' WHEN credit_score >= 650 THEN 'good'
                    WHEN credit_score >= 550 THEN 'fair' WHEN credit_score IS NOT NULL THEN 'poor' END AS credit_grade,
               CASE WHEN has_mobile THEN 'yes' ELSE 'no' END AS has_mobile,
               CASE WHEN customer_id % 9 <> 0 THEN CASE WHEN has_passport THEN 'yes' ELSE 'no' END END AS has_passport
        FROM {repairable}""",
    "business_events": """
        SELECT CAST(event_ts AS TIMESTAMP) AS event_ts, event_type FROM (
            SELECT MIN(o_orderdate) + INTERVAL '500' DAY AS event_ts, 'policy change' AS event_type
            FROM {orders}
            UNION ALL
            SELECT MAX(o_orderdate) - INTERVAL '700' DAY, 'system upgrade' FROM {orders}) e""",
    # Each customer's first urgent order stands in for a life event.
    "life_events": """
        SELECT o_custkey AS customer_id, CAST(MIN(o_orderdate) AS TIMESTAMP) AS event_ts,
               'house purchase' AS event_type
        FROM {orders} WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey""",
}


def _names(text: str) -> list[str]:
    return [n for _, n, _, _ in string.Formatter().parse(text) if n]


class Data:
    """The test tables of one scale, and the proxy views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or not (name in TABLES or name in PROXY):
            raise AttributeError(name)
        if name not in self._seen:
            self._seen[name] = (
                self.spark.read.parquet(f"{self.dir}/{name}.parquet")
                if name in TABLES
                else self.sql(PROXY[name])
            )
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in _names(text)})


def duck(text: str) -> str:
    """The same text as one statement: proxy views become CTEs, in order of need."""
    order: list[str] = []

    def need(name):
        if name in PROXY and name not in order:
            for n in _names(PROXY[name]):
                need(n)
            order.append(name)

    for n in _names(text):
        need(n)
    plain = {n: n for n in [*TABLES, *PROXY]}
    ctes = ",\n".join(f"{n} AS ({PROXY[n].format(**plain)})" for n in order)
    body = text.format(**plain).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


@dataclass
class Query:
    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(ids: str, sql: str | None = None, r6: str = "", r2: str = "", r4: str = ""):
    """Register a query under its function name.

    ``r2``/``r4``/``r6`` list the double columns that both sides round, to keep the last digits
    of differently ordered sums out of the comparison.
    """
    digits = {c: d for d, cols in ((2, r2), (4, r4), (6, r6)) for c in cols.split()}

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Data(spark, sf_dir))
            return df.withColumns(
                {c: F.round(F.col(c).cast("double"), d) + F.lit(0.0) for c, d in digits.items()}
            )

        text = None
        if sql is not None:
            text = duck(sql)
            if digits:
                reps = ", ".join(
                    f"ROUND(CAST({c} AS DOUBLE), {d}) + CAST(0 AS DOUBLE) AS {c}"
                    for c, d in digits.items()
                )
                text = f"SELECT * REPLACE ({reps}) FROM (\n{text}\n) AS result"
        if fn.__name__ in REGISTRY:
            raise ValueError(f"{fn.__name__} registered twice")
        REGISTRY[fn.__name__] = Query(fn.__name__, ids, run, text)
        return fn

    return register
