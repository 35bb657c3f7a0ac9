"""Sources that SQL can repeat, and cleaning."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from lendmend.operators import clean as C
from lendmend.operators import combine as J
from lendmend.operators.keyed import latest_per_key
from lendmend.plans.reports import as_json
from lendmend.sources import landing, relational, zones
from lendmend.sources.sync import Sync
from lendmend.sources.zones import shared_dir, written
from workload.base import query

DICTIONARY = {"customer_id": "bigint", "age": "int", "amount": "double", "work_type": "string"}


@query(
    "S2",
    """
    WITH sent AS (SELECT 'loans_' || year(o_orderdate) || '.csv' AS source_file, * FROM {orders}),
    landed AS (SELECT * FROM sent WHERE NOT (o_orderdate >= TIMESTAMP '1998-06-01'
                 AND o_orderdate < TIMESTAMP '1998-07-01' AND o_orderstatus = 'P')),
    s AS (SELECT source_file, count(*) AS n, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1999-03-01'
            AND o_orderdate < TIMESTAMP '1999-03-08') AS changed FROM sent GROUP BY 1),
    l AS (SELECT source_file, count(*) AS n FROM landed GROUP BY 1)
    SELECT s.source_file, s.n AS sent_rows, coalesce(l.n, 0) AS landed_rows,
           s.n = coalesce(l.n, 0) AND s.changed = 0 AS complete
    FROM s LEFT JOIN l USING (source_file)""",
)
def ingest_check(d):
    sent = d.orders.withColumn(
        "source_file", F.concat(F.lit("loans_"), F.year("o_orderdate"), F.lit(".csv"))
    )
    # A loss in transit: the pending loans of one month.
    lost = (
        (F.col("o_orderdate") >= "1998-06-01")
        & (F.col("o_orderdate") < "1998-07-01")
        & (F.col("o_orderstatus") == "P")
    )
    # A change in transit: in one week a text moved to the column beside it.
    late = (F.col("o_orderdate") >= "1999-03-01") & (F.col("o_orderdate") < "1999-03-08")
    sent = sent.withColumn("note", F.lit(None).cast("string"))
    landed = sent.where(~lost).withColumns(
        {
            "note": F.when(late, F.col("o_orderpriority")),
            "o_orderpriority": F.when(~late, F.col("o_orderpriority")),
        }
    )
    return landing.ingest_check(sent, landed)


@query(
    "S5 U3",
    """
    WITH base AS (SELECT loan_id, disbursed_amount, disbursed_date FROM {loans}
                  WHERE disbursed_date <= TIMESTAMP '2000-01-01'),
    delta AS (SELECT loan_id, disbursed_amount, disbursed_date FROM {loans}
              WHERE disbursed_date > TIMESTAMP '2000-01-01'
              UNION ALL
              SELECT loan_id, disbursed_amount + 1, disbursed_date + INTERVAL 3000 DAY FROM {loans}
              WHERE product = 'P' AND disbursed_date <= TIMESTAMP '2000-01-01'),
    both_sides AS (SELECT *, 0 AS src FROM base
                   UNION ALL SELECT *, 1 FROM delta WHERE disbursed_date > TIMESTAMP '2000-01-01')
    SELECT loan_id, disbursed_amount, strftime(disbursed_date, '%Y-%m-%d') AS day
    FROM (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY disbursed_date DESC, src DESC) AS rn
          FROM both_sides) x WHERE rn = 1""",
    r2="disbursed_amount",
)
def incremental_upsert(d):
    cut = "2000-01-01"
    loans = d.loans.select("loan_id", "disbursed_amount", "disbursed_date")
    base = loans.where(F.col("disbursed_date") <= F.lit(cut).cast("timestamp"))
    # The source has the later loans, and newer versions of the pending old ones.
    changed = d.loans.where(
        (F.col("product") == "P") & (F.col("disbursed_date") <= F.lit(cut).cast("timestamp"))
    ).select(
        "loan_id",
        (F.col("disbursed_amount") + 1).alias("disbursed_amount"),
        F.expr("disbursed_date + INTERVAL 3000 DAY").alias("disbursed_date"),
    )
    delta = relational.newer_than(loans.unionByName(changed), "disbursed_date", cut)
    merged = relational.upsert(base, delta, ["loan_id"], "disbursed_date")
    return merged.select(
        "loan_id", "disbursed_amount", F.date_format("disbursed_date", "yyyy-MM-dd").alias("day")
    )


@query(
    "S1",
    "SELECT CAST(o_orderkey AS VARCHAR) AS loan_id, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderstatus AS product, true AS whole FROM {orders}",
)
def spooled_files(d):
    """Orders land as CSV files and are picked up by the spooling stream, each row once."""
    root = f"{shared_dir(d.spark)}/spool-{uuid4().hex}"
    names = {"o_orderkey": "loan_id", "o_custkey": "customer_id", "o_orderstatus": "product"}
    d.orders.select(*names).write.option("header", True).csv(f"{root}/landing")
    spooled = landing.spool_csv(d.spark, f"{root}/landing", list(names), names)
    q = (
        spooled.writeStream.format("parquet").option("path", f"{root}/raw")
        .option("checkpointLocation", f"{root}/mark").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    whole = F.col(landing.CORRUPT).isNull() & F.col("source_file").isNotNull()
    return d.spark.read.parquet(f"{root}/raw").select("loan_id", "customer_id", "product", whole.alias("whole"))


@query(
    "S6",
    """SELECT loan_id, product, CASE WHEN product = 'F' THEN disbursed_amount + 1 ELSE disbursed_amount END AS disbursed_amount
       FROM {loans}""",
    r2="disbursed_amount",
)
def zone_partitions(d):
    """A second write replaces only the partitions it brings."""
    root = f"{shared_dir(d.spark)}/zones-{uuid4().hex}"
    rows = d.loans.select("loan_id", "disbursed_amount", "product")
    zones.zone_write(rows, root, "cleaned", "loans", ["product"])
    newer = rows.where("product = 'F'").withColumn("disbursed_amount", F.col("disbursed_amount") + 1)
    zones.zone_write(newer, root, "cleaned", "loans", ["product"])
    return zones.zone_read(d.spark, root, "cleaned", "loans").select("loan_id", "product", "disbursed_amount")


@query(
    "S5 U3",
    """SELECT loan_id, CASE WHEN loan_id % 50 = 1 THEN disbursed_amount + 1 ELSE disbursed_amount END AS disbursed_amount FROM {loans}""",
    r2="disbursed_amount",
)
def synced_loans(d):
    """Loans followed in three increments: the early ones, all with some changed since, and the same again."""
    copy = Sync(f"{shared_dir(d.spark)}/sync-{uuid4().hex}", "loan_id", "changed")
    rows = d.loans.select("loan_id", "disbursed_amount", F.col("disbursed_date").alias("changed"))
    newer = rows.where("loan_id % 50 = 1").select(
        "loan_id", (F.col("disbursed_amount") + 1).alias("disbursed_amount"), F.lit("2010-01-01").cast(rows.schema["changed"].dataType).alias("changed")
    )
    copy.run(rows.where("changed < '1996-01-01'"))
    copy.run(rows.unionByName(newer))
    copy.run(rows.unionByName(newer))
    return copy.read(d.spark).select("loan_id", "disbursed_amount")


@query(
    "S8",
    """SELECT b.customer_id, b.area_id, count(*) AS loans, true AS no_shuffle FROM {loans} l
       JOIN {customer_base} b ON b.customer_id = l.customer_id GROUP BY 1, 2""",
)
def bucketed_join(d):
    """Loans and customers in buckets by customer: joined and counted without a shuffle."""
    root, mark = f"{shared_dir(d.spark)}/bucketed-{uuid4().hex}", uuid4().hex[:12]
    loans = zones.cluster_by_key(d.loans, f"loans_{mark}", buckets=8, path=f"{root}/loans")
    people = zones.cluster_by_key(d.customer_base, f"people_{mark}", sort="area_id", buckets=8, path=f"{root}/people")
    people_rows = d.spark.table(people).select("customer_id", "area_id")
    joined = d.spark.table(loans).select("customer_id").hint("merge").join(people_rows, "customer_id")
    counted = joined.groupBy("customer_id", "area_id").agg(F.count(F.lit(1)).alias("loans"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    out = written(counted.withColumn("no_shuffle", F.lit("Exchange" not in plan)), "bucketed")
    for table in (loans, people):
        d.spark.sql(f"DROP TABLE {table}")
    return out


@query(
    "S7",
    """
    SELECT CAST(year(disbursed_date) AS INT) AS year, CAST(quarter(disbursed_date) AS INT) AS quarter,
           count(*) AS loans, sum(disbursed_amount) AS amount
    FROM {loans} WHERE disbursed_date >= TIMESTAMP '1996-11-15' AND disbursed_date < TIMESTAMP '1998-02-10'
    GROUP BY 1, 2""",
    r2="amount",
)
def year_quarter_table(d):
    path = zones.partitioned_table(
        d.loans, "disbursed_date", f"{shared_dir(d.spark)}/loans_by_quarter"
    )
    part = zones.between_dates(
        d.spark.read.parquet(path), "disbursed_date", "1996-11-15", "1998-02-10"
    )
    return part.groupBy("year", "quarter").agg(
        F.count(F.lit(1)).alias("loans"), F.sum("disbursed_amount").alias("amount")
    )


@query("S12", "SELECT count(*) AS payloads, count(DISTINCT loan_id) AS loans FROM {loans}")
def json_payloads(d):
    payload = as_json(d.loans.select("loan_id", "product", "disbursed_amount"))
    back = payload.select(F.from_json("payload", "loan_id bigint, product string").alias("m"))
    per_loan = back.groupBy("m.loan_id").agg(F.count(F.lit(1)).alias("n"))
    return per_loan.agg(F.sum("n").alias("payloads"), F.count("loan_id").alias("loans"))


@query(
    "P1",
    """
    SELECT CAST(customer_id AS BIGINT) AS customer_id, TRY_CAST(NULLIF(trim(age), '') AS INT) AS age,
           TRY_CAST(NULLIF(trim(amount), '') AS DOUBLE) AS amount, work_type,
           concat_ws(',', CASE WHEN trim(age) <> '' AND TRY_CAST(age AS INT) IS NULL THEN 'age' END,
                     CASE WHEN trim(amount) <> '' AND TRY_CAST(amount AS DOUBLE) IS NULL THEN 'amount' END)
             AS cast_errors
    FROM {raw_customers}""",
    r2="amount",
)
def typed_cells(d):
    out = C.typed(d.raw_customers, DICTIONARY)
    return out.withColumn("cast_errors", F.array_join("cast_errors", ","))


@query(
    "P2",
    "SELECT customer_id, age, coalesce(NOT (age BETWEEN 18 AND 100), false) AS bad_age FROM {customer_base}",
)
def age_flags(d):
    return C.flag_age(d.customer_base.select("customer_id", "age"))


@query(
    "P3",
    """SELECT customer_id, balance FROM (SELECT customer_id,
         CASE WHEN work_type = 'MACHINERY' AND balance > 9000 THEN NULL ELSE balance END AS balance
       FROM {customer_base}) x WHERE balance > 0 OR balance IS NULL""",
    r2="balance",
)
def positive_amounts(d):
    lost = (F.col("work_type") == "MACHINERY") & (F.col("balance") > 9000)
    rows = d.customer_base.select("customer_id", F.when(~lost, F.col("balance")).alias("balance"))
    return C.drop_nonpositive_amount(rows, "balance")


@query("P4", "SELECT loan_id, rate, (rate <= 0 OR rate > 36) AS bad_rate FROM {loans}", r2="rate")
def rate_flags(d):
    return C.flag_rate(d.loans.select("loan_id", "rate"))


@query(
    "P5",
    """SELECT loan_id, CASE WHEN x < 0 THEN NULL ELSE x END AS as_null, abs(x) AS as_abs,
              CASE WHEN x < 0 THEN 0 ELSE x END AS as_zero
       FROM (SELECT loan_id, CAST(overdue_cnt AS INT) - 1 AS x FROM {loan_history}) t""",
)
def overdue_fixes(d):
    x = d.loan_history.select("loan_id", (F.col("overdue_cnt") - 1).alias("x"))
    out = x
    for policy in ("null", "abs", "zero"):
        out = C.fix_overdue(out.withColumn(f"as_{policy}", F.col("x")), f"as_{policy}", policy)
    return out.drop("x")


def _split(d):
    rows = d.loans.join(d.customer_base.select("customer_id", "age"), "customer_id", "left")
    checks = {"age": C.age_out_of_range(), "rate": C.rate_out_of_range()}
    return C.split_quarantine(rows, checks)


@query(
    "P6 S10",
    """
    SELECT reasons, count(*) AS n FROM (
      SELECT concat_ws(',', CASE WHEN NOT (b.age BETWEEN 18 AND 100) THEN 'age' END,
                            CASE WHEN rate <= 0 OR rate > 36 THEN 'rate' END) AS reasons
      FROM {loans} l LEFT JOIN {customer_base} b ON b.customer_id = l.customer_id) x
    GROUP BY reasons""",
)
def quarantine_split(d):
    good, bad = _split(d)
    path = f"{shared_dir(d.spark)}/quarantine-{d.spark.sparkContext.applicationId}"
    from uuid import uuid4

    path = zones.quarantine_sink(bad, f"{path}-{uuid4().hex}")
    kept = good.select(F.lit("").alias("reasons")).unionByName(
        d.spark.read.parquet(path).select(F.array_join("reasons", ",").alias("reasons"))
    )
    return kept.groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


LINE_KEY = ("l_orderkey", "l_linenumber")
LINE_TIE = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus")


@query(
    "P7 W4",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate DESC, {", ".join(c + " DESC" for c in LINE_TIE)}) AS rn FROM {{lineitem}}) x
    WHERE rn = 1""",
    r2="l_extendedprice",
)
def newest_submission(d):
    order = [F.col("l_shipdate").desc()] + [F.col(c).desc() for c in LINE_TIE]
    out = latest_per_key(d.lineitem, list(LINE_KEY), order)
    return out.select(*LINE_KEY, "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")


@query(
    "P7",
    """
    SELECT loan_id, customer_id FROM (
      SELECT *, row_number() OVER (PARTITION BY customer_id, disbursed_date, disbursed_amount, term
                                   ORDER BY ingest_ts DESC, loan_id DESC) AS rn
      FROM (SELECT *, disbursed_date AS ingest_ts FROM {loans}
            UNION ALL SELECT *, disbursed_date + INTERVAL 1 DAY FROM {loans} WHERE product = 'F') u) x
    WHERE rn = 1""",
)
def deduplicated_loans(d):
    rows = d.loans.withColumn("ingest_ts", F.col("disbursed_date"))
    again = d.loans.where("product = 'F'").withColumn(
        "ingest_ts", F.expr("disbursed_date + INTERVAL 1 DAY")
    )
    keys = ("customer_id", "disbursed_date", "disbursed_amount", "term")
    return C.dedup_latest(rows.unionByName(again), keys).select("loan_id", "customer_id")


FIELDS = ["age", "credit_score", "work_type", "loan_cnt", "outstanding"]


@query(
    "P8 P9 P10 P11",
    """
    SELECT customer_id, CAST(m AS INT) AS missing_count, age IS NULL AS age_missing,
           credit_score IS NULL AS credit_score_missing, m / 5.0 > 0.5 AS low_quality,
           CASE WHEN m / 5.0 > 0.5 THEN 0.5 ELSE 1.0 END AS training_weight
    FROM (SELECT *, (age IS NULL)::INT + (credit_score IS NULL)::INT + (work_type IS NULL)::INT
                    + (loan_cnt IS NULL)::INT + (outstanding IS NULL)::INT AS m
          FROM (SELECT customer_id, age, credit_score, work_type,
                  CASE WHEN area_id < 5 THEN NULL ELSE loan_cnt END AS loan_cnt,
                  CASE WHEN area_id < 5 THEN NULL ELSE outstanding END AS outstanding
                FROM {customers}) v) x""",
    r2="training_weight",
)
def missing_marks(d):
    sparse = F.col("area_id") >= 5
    rows = d.customers.select(
        "customer_id", "age", "credit_score", "work_type",
        F.when(sparse, F.col("loan_cnt")).alias("loan_cnt"),
        F.when(sparse, F.col("outstanding")).alias("outstanding"),
    )
    out = C.missing_flags(C.missing_count(rows, FIELDS), ["age", "credit_score"])
    out = C.training_weight(C.low_quality(out, FIELDS))
    return out.select(
        "customer_id", "missing_count", "age_missing", "credit_score_missing", "low_quality",
        "training_weight",
    )


@query(
    "P12",
    """
    WITH c AS (SELECT * FROM {customers})
    SELECT kind, name, CAST(n AS BIGINT) AS n, CAST(n AS DOUBLE) / total AS share FROM (
      SELECT 'missing' AS kind, 'age' AS name, count(*) FILTER (WHERE age IS NULL) AS n, count(*) AS total FROM c
      UNION ALL SELECT 'missing', 'credit_score', count(*) FILTER (WHERE credit_score IS NULL), count(*) FROM c
      UNION ALL SELECT 'missing', 'work_type', count(*) FILTER (WHERE work_type IS NULL), count(*) FROM c
      UNION ALL SELECT 'rule', 'age', count(*) FILTER (WHERE NOT (age BETWEEN 18 AND 100)), count(*) FROM c
      UNION ALL SELECT 'rule', 'balance', count(*) FILTER (WHERE balance < 0), count(*) FROM c) x""",
    r6="share",
)
def quality_report(d):
    checks = {"age": C.age_out_of_range(), "balance": F.col("balance") < 0}
    return C.quality_report(d.customers, ["age", "credit_score", "work_type"], checks)


@query(
    "P13 J1",
    """
    SELECT b.customer_id, b.age, b.work_type, u.credit_score, a.pri_loan_cnt, l.loan_rows, l.loan_amount
    FROM {customer_base} b
    LEFT JOIN {credit_bureau} u ON u.customer_id = b.customer_id
    LEFT JOIN {account_behavior} a ON a.customer_id = b.customer_id
    LEFT JOIN (SELECT customer_id, count(*) AS loan_rows, sum(disbursed_amount) AS loan_amount
               FROM {loans} GROUP BY customer_id) l ON l.customer_id = b.customer_id
    WHERE b.customer_id IN (SELECT user_id FROM {events} WHERE event_type = 'purchase')""",
    r2="loan_amount",
)
def customer_profiles(d):
    view = J.customer_view(
        d.customer_base, d.loans, d.account_behavior, bureau=d.credit_bureau
    )
    asked = d.applications.where("purpose = 'purchase'").select("customer_id")
    return J.profile(view, asked).select(
        "customer_id", "age", "work_type", "credit_score", "pri_loan_cnt", "loan_rows", "loan_amount"
    )
