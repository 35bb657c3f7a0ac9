"""Joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendmend.operators import combine as J
from lendmend.operators import features as X
from lendmend.operators.customers import improvement_trend, timeline, timeline_order
from lendmend.operators.keyed import latest_per_key
from lendmend.operators.similar import probed_share, similar, similar_probed, top_k_similar
from lendmend.sources.zones import discard, written
from workload.base import AS_OF, query


@query(
    "J1",
    """
    SELECT b.customer_id, b.area_id, l.loan_rows, l.loan_amount, strftime(l.first_loan, '%Y-%m-%d') AS first_day,
           a.pri_loan_cnt, a.sec_loan_cnt, u.credit_score
    FROM {customer_base} b
    LEFT JOIN (SELECT customer_id, count(*) AS loan_rows, sum(disbursed_amount) AS loan_amount,
                      min(disbursed_date) AS first_loan FROM {loans} GROUP BY customer_id) l
      ON l.customer_id = b.customer_id
    LEFT JOIN {account_behavior} a ON a.customer_id = b.customer_id
    LEFT JOIN {credit_bureau} u ON u.customer_id = b.customer_id""",
    r2="loan_amount",
)
def customer_view(d):
    view = J.customer_view(d.customer_base, d.loans, d.account_behavior, bureau=d.credit_bureau)
    return view.select(
        "customer_id", "area_id", "loan_rows", "loan_amount",
        F.date_format("first_loan", "yyyy-MM-dd").alias("first_day"),
        "pri_loan_cnt", "sec_loan_cnt", "credit_score",
    )


@query(
    "J2",
    """SELECT c.customer_id, c.area_id, a.area_name, a.region_name, a.latitude, a.longitude
       FROM {customer_base} c LEFT JOIN {areas} a ON a.area_id = c.area_id""",
)
def area_lookup(d):
    return J.with_area(d.customer_base.select("customer_id", "area_id"), d.areas).select(
        "customer_id", "area_id", "area_name", "region_name", "latitude", "longitude"
    )


TOP5 = """
    SELECT customer_id, neighbour, similarity, rank FROM (
      SELECT a.vec_id AS customer_id, b.vec_id AS neighbour,
             list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity,
             CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY
                  list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS INT) AS rank
      FROM {embeddings} a JOIN {embeddings} b ON a.vec_id <> b.vec_id) x WHERE rank <= 5"""


def _vectors(d):
    return d.embeddings.select(F.col("vec_id").alias("customer_id"), "embedding")


def clustered_vectors(d):
    """Sixteen numbers of each order: those of its customer's cluster, and a little of its own."""
    order, spot = F.col("o_orderkey"), F.col("o_custkey") % 60
    own = [F.sin(spot * (3 * i + 7) % 61) * 4 + F.sin(order * (i + 1)) * 0.5 for i in range(16)]
    return d.orders.select(order.alias("customer_id"), F.array(*own).alias("v")).where("customer_id % 5 = 0")


@query(
    "J4",
    "SELECT count(*) AS queries, true AS recall_at_least_95, true AS at_most_a_tenth_compared FROM {orders} WHERE o_orderkey % 5 = 0",
)
def probed_neighbours(d):
    """Neighbours from the nearest cells only, held against the exact ones. Below 1000 vectors there are too
    few cells for a share."""
    v = written(clustered_vectors(d), "vectors")
    size = max(20, v.count() // 100)
    exact = similar(v, v, "v", 5).select("customer_id", "neighbour")
    near = similar_probed(v, v, "v", 5, probes=4, cell_rows=size).select("customer_id", "neighbour")
    hit, all_ = near.join(exact, ["customer_id", "neighbour"]).count(), exact.count()
    discard(near, exact)
    share = probed_share(v, v, "v", probes=4, cell_rows=size)
    return v.agg(F.count(F.lit(1)).alias("queries")).select(
        "queries", F.lit(hit >= 0.95 * all_).alias("recall_at_least_95"), (F.lit(share <= 0.1) | (F.col("queries") < 1000)).alias("at_most_a_tenth_compared")
    )


@query("J4 W9 F15", TOP5, r6="similarity")
def similar_customers(d):
    v = _vectors(d)
    return similar(v, v, "embedding", 5)


@query("W9", TOP5, r6="similarity")
def top_k_of_neighbours(d):
    v = _vectors(d)
    return top_k_similar(similar(v, v, "embedding", 12).drop("rank"), 5)


@query(
    "J5",
    """
    SELECT event_type, phase, count(*) AS loans, sum(disbursed_amount) AS amount FROM (
      SELECT e.event_type, l.disbursed_amount,
             CASE WHEN l.disbursed_date::DATE < e.event_ts::DATE THEN 'before' ELSE 'after' END AS phase
      FROM {loans} l JOIN {business_events} e
        ON l.disbursed_date::DATE >= (e.event_ts::DATE - INTERVAL 6 MONTH)::DATE
       AND l.disbursed_date::DATE < (e.event_ts::DATE + INTERVAL 6 MONTH)::DATE) x
    GROUP BY 1, 2""",
    r2="amount",
)
def loans_near_events(d):
    near = J.near_events(d.loans, "disbursed_date", d.business_events, 6, 6)
    return near.groupBy("event_type", "phase").agg(
        F.count(F.lit(1)).alias("loans"), F.sum("disbursed_amount").alias("amount")
    )


def _trail(months):
    cols = []
    for m in months:
        w = f"PARTITION BY customer_id ORDER BY disbursed_date RANGE BETWEEN INTERVAL {m} MONTH PRECEDING AND CURRENT ROW"
        p = "PARTITION BY customer_id ORDER BY disbursed_date RANGE BETWEEN CURRENT ROW AND CURRENT ROW"
        cols.append(f"count(*) OVER ({w}) - count(*) OVER ({p}) AS cnt_{m}m")
        cols.append(
            f"sum(disbursed_amount) OVER ({w}) - sum(disbursed_amount) OVER ({p}) AS amt_{m}m"
        )
    return f"SELECT loan_id, {', '.join(cols)} FROM {{loans}}"


@query("J6", _trail((9,)).replace("cnt_9m", "prior_cnt").replace("amt_9m", "prior_amount"), r2="prior_amount")
def prior_loans(d):
    return J.prior_loans(d.loans, 9).select("loan_id", "prior_cnt", "prior_amount")


@query("W1", _trail((3, 6, 12)), r2="amt_3m amt_6m amt_12m")
def trailing_windows(d):
    out = X.trailing_loans(d.loans)
    return out.select("loan_id", *[f"{k}_{m}m" for m in (3, 6, 12) for k in ("cnt", "amt")])


HOT = "CASE WHEN customer_id % 3 = 0 THEN 0 ELSE customer_id END"


@query(
    "W1",
    _trail((3, 12)).replace("{loans}", f"(SELECT * EXCLUDE (customer_id), {HOT} AS customer_id FROM {{loans}})"),
    r2="amt_3m amt_12m",
)
def trailing_windows_hot_keys(d):
    """One customer has a third of all loans."""
    out = X.trailing_loans(d.loans.withColumn("customer_id", F.expr(HOT)), (3, 12))
    return out.select("loan_id", *[f"{k}_{m}m" for m in (3, 12) for k in ("cnt", "amt")])


@query(
    "J7",
    """
    WITH s AS (SELECT customer_id, amount, date_trunc('week', apply_time) AS snapshot_ts FROM {applications})
    SELECT customer_id, sum(amount) AS amount, count(*) AS n FROM s
    WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM s WHERE snapshot_ts <= TIMESTAMP '2024-01-20 12:00:00')
    GROUP BY 1""",
    r2="amount",
)
def snapshot_lookup(d):
    table = d.applications.withColumn("snapshot_ts", F.date_trunc("week", "apply_time"))
    return J.snapshot_at(table, "2024-01-20 12:00:00").groupBy("customer_id").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n")
    )


@query(
    "J7",
    """
    SELECT customer_id, loan_id FROM (
      SELECT customer_id, loan_id, row_number() OVER (PARTITION BY customer_id
             ORDER BY disbursed_date DESC, loan_id DESC) AS rn
      FROM {loans} WHERE disbursed_date <= TIMESTAMP '1999-06-30') x WHERE rn = 1""",
)
def as_of_lookup(d):
    table = d.loans.withColumnRenamed("disbursed_date", "snapshot_ts")
    newest = J.latest_snapshot_per_key(table, ["customer_id"], "1999-06-30", (F.col("loan_id").desc(),))
    return newest.select("customer_id", "loan_id")


@query(
    "J8",
    """SELECT customer_id, area_id, loan_default FROM {customers}
       WHERE area_id IN (SELECT area_id FROM {areas} WHERE region_name IN ('ASIA', 'EUROPE'))""",
)
def members_of_areas(d):
    chosen = d.areas.where(F.col("region_name").isin("ASIA", "EUROPE"))
    return J.members(
        d.customers.select("customer_id", "area_id", "loan_default"), chosen.select("area_id"), "area_id"
    )


@query(
    "J9",
    "SELECT customer_id FROM {customer_base} WHERE customer_id NOT IN (SELECT customer_id FROM {applications})",
)
def unseen_customers(d):
    return J.new_keys(
        d.customer_base.select("customer_id"), d.applications.select("customer_id"), "customer_id"
    )


@query(
    "W2",
    f"""SELECT customer_id, date_diff('day', min(disbursed_date)::DATE, DATE '{AS_OF}')::INT AS first_loan_days
        FROM {{loans}} GROUP BY 1""",
)
def first_loan_age(d):
    return X.first_loan_age(d.loans, AS_OF)


BURST = """
    SELECT application_id, count(*) OVER w AS cnt_burst, count(*) OVER w >= 4 AS burst,
           (epoch_us(apply_time) - epoch_us(max(apply_time) OVER (PARTITION BY customer_id ORDER BY apply_time
              RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))) / 1000000.0 AS gap_seconds
    FROM {applications}
    WINDOW w AS (PARTITION BY customer_id ORDER BY apply_time RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)"""


@query("W3", BURST, r6="gap_seconds")
def application_bursts(d):
    out = X.application_burst(d.applications, "apply_time", 4, 1)
    return out.select("application_id", "cnt_burst", "burst", "gap_seconds")


@query(
    "W3",
    BURST.replace("{applications}", f"(SELECT * EXCLUDE (customer_id), {HOT} AS customer_id FROM {{applications}})"),
    r6="gap_seconds",
)
def application_bursts_hot_keys(d):
    """One customer has a third of all applications."""
    apps = d.applications.withColumn("customer_id", F.expr(HOT))
    out = X.application_burst(apps, "apply_time", 4, 1)
    return out.select("application_id", "cnt_burst", "burst", "gap_seconds")


@query(
    "W7",
    """
    WITH m AS (SELECT customer_id, year(disbursed_date) * 12 + month(disbursed_date) - 1 AS m,
                      CASE WHEN overdue_cnt > 0 THEN 1 ELSE 0 END AS bad FROM {loan_history}),
    b AS (SELECT customer_id, min(m) + max(m) AS mid FROM m GROUP BY 1),
    h AS (SELECT customer_id, count(*) AS loans,
                 avg(bad) FILTER (WHERE m * 2 <= mid) AS first_half, avg(bad) FILTER (WHERE m * 2 > mid) AS last_half
          FROM m JOIN b USING (customer_id) GROUP BY 1)
    SELECT *, CASE WHEN last_half < first_half THEN 'improving' WHEN last_half > first_half THEN 'worsening'
                   WHEN last_half = first_half THEN 'stable' END AS trend FROM h""",
    r6="first_half last_half",
)
def improvement_trends(d):
    return improvement_trend(d.loan_history, "disbursed_date", F.col("overdue_cnt") > 0)


EVENTS = """
    SELECT customer_id, strftime(disbursed_date - INTERVAL 7 DAY, '%Y-%m-%d') AS day, 'application' AS event,
           'grey' AS colour, disbursed_amount AS amount FROM {loan_history}
    UNION ALL
    SELECT customer_id, strftime(disbursed_date, '%Y-%m-%d'), 'disbursement', 'grey', disbursed_amount FROM {loan_history}
    UNION ALL
    SELECT customer_id, strftime(disbursed_date + INTERVAL 30 DAY, '%Y-%m-%d'),
           CASE WHEN overdue_cnt >= 3 THEN 'severe_default' WHEN overdue_cnt > 0 THEN 'overdue' ELSE 'repaid_on_time' END,
           CASE WHEN overdue_cnt >= 3 THEN 'red' WHEN overdue_cnt > 0 THEN 'yellow' ELSE 'green' END,
           disbursed_amount FROM {loan_history}
    UNION ALL
    SELECT customer_id, strftime(disbursed_date + INTERVAL 360 DAY, '%Y-%m-%d'), 'settled', 'blue', disbursed_amount
    FROM {loan_history} WHERE product = 'F'"""


def loan_events(d):
    loans = d.loan_history.withColumn("amount", F.col("disbursed_amount"))

    def at(days, df=loans):
        return df.withColumn("ts", F.expr(f"disbursed_date + INTERVAL '{days}' DAY"))

    return timeline(at(-7), at(0), at(30), at(360, loans.where("product = 'F'")))


@query("U1 W12 C8", EVENTS, r2="amount")
def customer_timelines(d):
    return timeline_order(loan_events(d)).select(
        "customer_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event", "colour", "amount"
    )


@query(
    "U2 T9",
    """
    SELECT origin, count(*) AS n, sum(amount) AS amount, count(term) AS with_term FROM (
      SELECT 'batch' AS origin, disbursed_amount AS amount, term FROM {loans}
      UNION ALL SELECT 'live', amount, NULL FROM {applications}) x GROUP BY 1""",
    r2="amount",
)
def history_and_live(d):
    batch = d.loans.select("customer_id", F.col("disbursed_amount").alias("amount"), "term")
    live = d.applications.select("customer_id", "amount", "purpose")
    return J.combined(batch, live).groupBy("origin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.count("term").alias("with_term")
    )
