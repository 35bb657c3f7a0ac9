"""Aggregations, dashboards, scalar functions."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from lendmend.functions import bands, dates, metrics, payload, ratios, vectors
from lendmend.functions.items import items
from lendmend.functions.scorecard import score
from lendmend.operators import clean, encode, features, select
from lendmend.operators import combine as J
from lendmend.operators.customers import score_evolution
from lendmend.operators.scoring import risk_tier, score_band_default_rate, scorecard, validate_scores
from lendmend.plans import reports as P
from lendmend.sources.zones import shared_dir
from workload.base import query


@query(
    "A2 J2 F12 A1",
    """
    SELECT a.area_id, a.area_name, count(*) AS customers, count(*) FILTER (WHERE loan_default = 1) AS defaulted,
           avg(loan_default) AS default_rate,
           CASE WHEN avg(loan_default) >= 0.10 THEN 'red' WHEN avg(loan_default) >= 0.05 THEN 'yellow' ELSE 'green' END AS heat
    FROM {customers} c LEFT JOIN {areas} a ON a.area_id = c.area_id
    WHERE coalesce(c.age BETWEEN 18 AND 100, true)
    GROUP BY 1, 2""",
    r6="default_rate",
)
def area_risk_heat(d):
    """Flagship: bad ages out, five tables joined, accounts totalled, rate per area, colour."""
    base = clean.flag_age(d.customer_base).where("NOT bad_age")
    accounts = features.account_totals(d.account_behavior)
    rate = ratios.overdue_rate("total_overdue_cnt", "total_loan_cnt")
    view = J.customer_view(base, accounts=accounts).withColumn(
        "loan_default", F.when(rate > 0.45, 1).otherwise(0)
    )
    rates = P.area_default_rate(view)
    return J.with_area(rates, d.areas).select(
        "area_id", "area_name", "customers", "defaulted", "default_rate", "heat"
    ).orderBy(F.col("default_rate").desc(), "area_id")


@query(
    "A1",
    """SELECT customer_id, pri_loan_cnt + sec_loan_cnt AS total_loan_cnt,
              pri_overdue_cnt + sec_overdue_cnt AS total_overdue_cnt,
              pri_outstanding + sec_outstanding AS total_outstanding,
              pri_installment + sec_installment AS total_installment FROM {account_behavior}""",
    r4="total_outstanding total_installment",
)
def account_totals(d):
    return features.account_totals(d.account_behavior).select(
        "customer_id", "total_loan_cnt", "total_overdue_cnt", "total_outstanding", "total_installment"
    )


@query(
    "A2 A20 T5",
    """
    SELECT area_id, default_rate, heat, CASE heat WHEN 'red' THEN 'stricter approval, lower limit'
           WHEN 'yellow' THEN 'monitor' ELSE 'expand' END AS action, '2001-08-01 07' AS refreshed
    FROM (SELECT area_id, avg(loan_default) AS default_rate,
            CASE WHEN avg(loan_default) >= 0.10 THEN 'red' WHEN avg(loan_default) >= 0.05 THEN 'yellow' ELSE 'green' END AS heat
          FROM {customers} GROUP BY 1) x""",
    r6="default_rate",
)
def area_policy(d):
    hot = P.area_policy(P.refresh_heat(d.customers, "2001-08-01 07:45:00"))
    return hot.select(
        "area_id", "default_rate", "heat", "action",
        F.date_format("refreshed_at", "yyyy-MM-dd HH").alias("refreshed"),
    )


@query(
    "A3",
    """
    SELECT area_id, count(*) AS customers, sum(amount) AS loan_amount,
           count(*) FILTER (WHERE loan_default = 1) AS defaulted,
           coalesce(sum(amount) FILTER (WHERE loan_default = 1), 0) AS default_amount,
           avg(credit_score) AS mean_score
    FROM {customers} c LEFT JOIN (SELECT customer_id AS cid, sum(disbursed_amount) AS amount FROM {loans} GROUP BY 1) l
      ON l.cid = c.customer_id
    GROUP BY 1""",
    r2="loan_amount default_amount",
    r6="mean_score",
)
def area_stats(d):
    return P.area_stats(d.customers, d.loans)


@query(
    "A4",
    """
    SELECT area_id, product, customer_type, count(*) AS loans, sum(disbursed_amount) AS loan_amount,
           avg(CASE WHEN overdue_cnt > 0 THEN 1.0 ELSE 0.0 END) AS default_rate,
           CAST((grouping(area_id) = 0)::INT + (grouping(product) = 0)::INT + (grouping(customer_type) = 0)::INT AS INT) AS level
    FROM {loan_history} GROUP BY ROLLUP (area_id, product, customer_type)""",
    r2="loan_amount",
    r6="default_rate",
)
def drill_down(d):
    loans = d.loan_history.withColumn("loan_default", F.when(F.col("overdue_cnt") > 0, 1).otherwise(0))
    return P.drill(loans)


MONTHLY = """SELECT strftime(disbursed_date, '%Y-%m') AS month, {dims} count(*) AS loans,
    count(*) FILTER (WHERE overdue_cnt > 0) AS overdue_loans,
    avg(CASE WHEN overdue_cnt > 0 THEN 1.0 ELSE 0.0 END) AS overdue_rate FROM {{loan_history}} GROUP BY ALL"""


@query("A5", MONTHLY.format(dims=""), r6="overdue_rate")
def monthly_overdue_rate(d):
    return P.monthly_overdue_rate(d.loan_history)


@query("A6", MONTHLY.format(dims="product, customer_type,"), r6="overdue_rate")
def overdue_rate_by_product_and_segment(d):
    return P.overdue_rate_by(d.loan_history, ["product", "customer_type"])


@query(
    "A6",
    """SELECT strftime(disbursed_date, '%Y-%m') AS month,
          avg((overdue_cnt > 0)::INT) FILTER (WHERE product = 'F') AS F, avg((overdue_cnt > 0)::INT) FILTER (WHERE product = 'O') AS O,
          avg((overdue_cnt > 0)::INT) FILTER (WHERE product = 'P') AS P FROM {loan_history} GROUP BY 1""",
    r6="F O P",
)
def overdue_rate_wide(d):
    return P.overdue_rate_wide(d.loan_history, "product", ["F", "O", "P"])


@query(
    "A7",
    """
    WITH l AS (SELECT year(disbursed_date) * 12 + month(disbursed_date) AS m, (overdue_cnt > 0)::INT AS bad FROM {loan_history}),
    e AS (SELECT event_type, strftime(event_ts, '%Y-%m') AS event_month, year(event_ts) * 12 + month(event_ts) AS em FROM {business_events})
    SELECT event_type, event_month, avg(bad) FILTER (WHERE m < em) AS rate_before, avg(bad) FILTER (WHERE m >= em) AS rate_after
    FROM e JOIN l ON m >= em - 6 AND m <= em + 5 GROUP BY 1, 2""",
    r6="rate_before rate_after",
)
def event_effect(d):
    return P.event_effect(d.loan_history, d.business_events, 6)


TIER = """(SELECT *, CASE WHEN cume_dist() OVER (ORDER BY p) <= 0.7 THEN 'low'
                  WHEN cume_dist() OVER (ORDER BY p) <= 0.9 THEN 'mid' ELSE 'high' END AS tier FROM {scored}) t"""


@query("W6", f"SELECT customer_id, p, tier FROM {TIER}", r6="p")
def risk_tiers(d):
    return risk_tier(d.scored.select("customer_id", "p"))


@query(
    "A8",
    f"SELECT tier, count(*) AS customers, count(*) / (sum(count(*)) OVER ()) AS share FROM {TIER} GROUP BY tier",
    r6="share",
)
def tier_distribution(d):
    return P.tier_distribution(risk_tier(d.scored))


@query(
    "A9",
    f"SELECT tier, sum(amount) AS amount, sum(amount) / (sum(sum(amount)) OVER ()) AS amount_share FROM {TIER} GROUP BY tier",
    r2="amount",
    r6="amount_share",
)
def tier_exposure(d):
    return P.tier_exposure(risk_tier(d.scored), "amount")


@query(
    "A10",
    """SELECT strftime(disbursed_date, '%Y-%m') AS month, count(*) AS loans, count(*) FILTER (WHERE overdue_cnt > 0) AS overdue_loans,
         avg((overdue_cnt > 0)::INT) AS overdue_rate
       FROM {loan_history} WHERE area_id IN (1, 2, 3, 4) AND product IN ('O', 'F')
         AND disbursed_date >= TIMESTAMP '1997-01-01' AND disbursed_date < TIMESTAMP '1999-01-01' GROUP BY 1""",
    r6="overdue_rate",
)
def filtered_trend(d):
    rows = P.filtered(d.loan_history, [1, 2, 3, 4], ["O", "F"], ("1997-01-01", "1999-01-01"))
    return P.monthly_overdue_rate(rows)


KPI = """
    SELECT count(*) AS customers, sum(amount) AS loan_amount, sum(bad) / sum(n) AS overdue_rate,
           count(*) FILTER (WHERE first >= DATE '1996-03-01') AS new_customers
    FROM (SELECT customer_id, sum(disbursed_amount) AS amount, count(*) AS n, min(disbursed_date)::DATE AS first,
                 count(*) FILTER (WHERE overdue_cnt > 0) AS bad
          FROM {loan_history} WHERE disbursed_date::DATE <= DATE '1996-03-20' GROUP BY 1) x"""


@query("A11", KPI, r2="loan_amount", r6="overdue_rate")
def kpis(d):
    return P.kpis(d.loan_history, "1996-03-20")


@query(
    "A12",
    """SELECT CAST((credit_score >= 400)::INT + (credit_score >= 550)::INT + (credit_score >= 650)::INT + (credit_score >= 750)::INT AS INT) AS bin,
         count(*) AS n FROM {customers} WHERE credit_score IS NOT NULL GROUP BY 1""",
)
def score_histogram(d):
    return P.histogram(d.customers, "credit_score", [400, 550, 650, 750])


GRADED = """(SELECT customer_id, CAST(300 + 550 * (1 - p) AS DOUBLE) AS score, disbursed AS amount, overdue_rate, loan_default,
   CAST(CASE WHEN p < 0.2 THEN 1 WHEN p < 0.3 THEN 2 WHEN p < 0.35 THEN 3 WHEN p < 0.45 THEN 4 ELSE 5 END AS INT) AS cluster
   FROM {scored}) g"""


def graded(d):
    p = F.col("p")
    cluster = F.when(p < 0.2, 1).when(p < 0.3, 2).when(p < 0.35, 3).when(p < 0.45, 4).otherwise(5)
    return d.scored.select(
        "customer_id", (300 + 550 * (1 - p)).alias("score"), F.col("disbursed").alias("amount"),
        "overdue_rate", "loan_default", cluster.alias("cluster"),
    )


@query(
    "A13 C5",
    f"""SELECT cluster, count(*) AS customers, avg(score) AS mean_score, avg(amount) AS mean_amount,
          avg(overdue_rate) AS overdue_rate, count(*) / (sum(count(*)) OVER ()) AS share FROM {GRADED} GROUP BY cluster""",
    r2="mean_amount",
    r6="mean_score overdue_rate share",
)
def cluster_profile(d):
    return P.cluster_profile(graded(d))


@query(
    "A14",
    f"""SELECT band, customers, default_rate, coalesce(default_rate <= lag(default_rate) OVER (ORDER BY band), true) AS monotone
        FROM (SELECT CAST((score >= 550)::INT + (score >= 620)::INT + (score >= 700)::INT + (score >= 800)::INT AS INT) AS band,
                     count(*) AS customers, avg(loan_default) AS default_rate FROM {GRADED} GROUP BY 1) x""",
    r6="default_rate",
)
def score_band_rates(d):
    return score_band_default_rate(graded(d), [550, 620, 700, 800])


AUC_SQL = """(SELECT (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
     / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc
   FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM {src}) ranked)"""


@query(
    "M14",
    f"""WITH b AS (SELECT CAST((score >= 550)::INT + (score >= 700)::INT AS INT) AS band, avg(loan_default) AS rate FROM {GRADED} GROUP BY 1),
        v AS (SELECT loan_default AS y, -score AS p FROM {GRADED})
        SELECT (SELECT count(*) FROM b) AS bands,
          (SELECT bool_and(coalesce(rate <= prev, true)) FROM (SELECT rate, lag(rate) OVER (ORDER BY band) AS prev FROM b) x) AS monotone,
          auc FROM {AUC_SQL.replace("{src}", "v")} a""",
    r6="auc",
)
def score_validation(d):
    return validate_scores(graded(d), [550, 700])


@query(
    "A15",
    "SELECT work_type, count(*) AS n, count(*) / (sum(count(*)) OVER ()) AS share FROM {customers} GROUP BY 1",
    r6="share",
)
def value_frequency(d):
    return encode.frequency(d.customers, "work_type")


@query(
    "A16",
    """SELECT 'overdue_cnt' AS feature, corr(overdue_cnt, loan_default) AS r FROM {customers}
       UNION ALL SELECT 'credit_score', corr(credit_score, loan_default) FROM {customers}
       UNION ALL SELECT 'balance', corr(balance, loan_default) FROM {customers}
       UNION ALL SELECT 'loan_cnt', corr(loan_cnt, loan_default) FROM {customers}""",
    r6="r",
)
def label_correlations(d):
    return select.corr_with_label(
        d.customers, ["overdue_cnt", "credit_score", "balance", "loan_cnt"], "loan_default"
    )


@query(
    "A18",
    """
    SELECT strftime(p.day, '%Y-%m-%d') AS day, predictions, accuracy, repairs, repair_success FROM
      (SELECT apply_time::DATE AS day, count(*) AS predictions, avg(((amount > 15) = (purpose = 'error'))::INT) AS accuracy
       FROM {applications} GROUP BY 1) p
      FULL JOIN (SELECT apply_time::DATE AS day, count(*) AS repairs, avg((amount > 5)::INT) AS repair_success
       FROM {applications} WHERE purpose = 'signup' GROUP BY 1) r ON r.day = p.day""",
    r6="accuracy repair_success",
)
def model_monitor(d):
    pred, rep = _logs(d)
    return P.model_monitor(pred, rep).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _logs(d):
    pred = d.applications.select(
        F.col("apply_time").alias("ts"), (F.col("amount") > 15).alias("predicted"),
        (F.col("purpose") == "error").alias("label"),
    )
    rep = d.applications.where("purpose = 'signup'").select(
        F.col("apply_time").alias("ts"), (F.col("amount") > 5).alias("repaired")
    )
    return pred, rep


@query(
    "A19",
    f"SELECT cluster, count(*) AS customers, count(*) FILTER (WHERE cluster = 1 AND amount > 400000) AS opportunities FROM {GRADED} GROUP BY 1",
)
def segment_counts(d):
    return P.segment_counts(graded(d), (F.col("cluster") == 1) & (F.col("amount") > 400000))


@query(
    "A21",
    f"""
    WITH t AS (SELECT tier, (first_loan > DATE '1995-01-25' AND first_loan <= DATE '1995-04-25') AS fresh
               FROM {TIER} JOIN (SELECT customer_id AS cid, min(disbursed_date)::DATE AS first_loan FROM {{loans}} GROUP BY 1) f ON f.cid = t.customer_id),
    g AS (SELECT tier, count(*) AS customers, count(*) FILTER (WHERE fresh) AS new_customers FROM t GROUP BY 1)
    SELECT tier, customers, new_customers, customers / (sum(customers) OVER ()) AS share,
           new_customers / (sum(new_customers) OVER ()) AS new_share,
           new_customers / (sum(new_customers) OVER ()) - customers / (sum(customers) OVER ()) AS difference
    FROM g""",
    r6="share new_share difference",
)
def new_customer_tiers(d):
    first = J.loans_by_customer(d.loans).select("customer_id", "first_loan")
    scored = risk_tier(d.scored).join(first, "customer_id")
    return P.new_customer_tiers(scored, "1995-04-25", 3)


@query(
    "W8 C3",
    """
    WITH y AS (SELECT customer_id, CAST(year(disbursed_date) AS INT) AS period, count(*) AS loans, avg(rate) AS capacity FROM {loans} GROUP BY 1, 2)
    SELECT *, loans - lag(loans) OVER w AS loans_change, capacity - lag(capacity) OVER w AS capacity_change
    FROM y WHERE period > (SELECT max(period) FROM y) - 3 WINDOW w AS (PARTITION BY customer_id ORDER BY period)""",
    r6="capacity capacity_change",
)
def score_evolution_by_year(d):
    yearly = d.loans.groupBy("customer_id", F.year("disbursed_date").alias("period")).agg(
        F.count(F.lit(1)).alias("loans"), F.avg("rate").alias("capacity")
    )
    return score_evolution(yearly, ("loans", "capacity"), years=3)


MONTH_RATES = "(SELECT strftime(disbursed_date, '%Y-%m') AS month, avg((overdue_cnt > 0)::INT) AS overdue_rate FROM {loan_history} GROUP BY 1) m"


@query(
    "W11",
    f"""SELECT month, overdue_rate, trailing_mean, coalesce(overdue_rate > trailing_mean * 1.1, false) AS alert
        FROM (SELECT *, avg(overdue_rate) OVER (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS trailing_mean FROM {MONTH_RATES}) x""",
    r6="overdue_rate trailing_mean",
)
def rate_jump_alerts(d):
    series = P.monthly_overdue_rate(d.loan_history).select("month", "overdue_rate")
    return P.alert_rate_jump(series, "overdue_rate", "month", n=6, factor=1.1)


@query(
    "T7",
    """SELECT strftime(disbursed_date, '%Y-%m') AS month, count(*) AS loans, count(*) FILTER (WHERE overdue_cnt > 0) AS overdue_loans,
         avg((overdue_cnt > 0)::INT) AS overdue_rate, CAST(0.05 AS DOUBLE) AS "limit" FROM {loan_history} GROUP BY 1
       HAVING avg((overdue_cnt > 0)::INT) > 0.05""",
    r6="overdue_rate",
)
def trend_alerts(d):
    return P.trend_alerts(P.monthly_overdue_rate(d.loan_history), 0.05)


PANELS = f"""
    SELECT 'kpis' AS report, count(*) AS n FROM ({KPI}) a
    UNION ALL SELECT 'overdue_trend', count(DISTINCT strftime(disbursed_date, '%Y-%m')) FROM {{loan_history}}
    UNION ALL SELECT 'tiers', count(DISTINCT tier) FROM {TIER}
    UNION ALL SELECT 'area_heat', count(DISTINCT area_id) FROM {{customers}}
    UNION ALL SELECT 'score_histogram', count(DISTINCT (credit_score >= 550)::INT + (credit_score >= 650)::INT + (credit_score >= 750)::INT) FROM {{customers}}
    UNION ALL SELECT 'amount_histogram', count(DISTINCT (disbursed_amount >= 10000)::INT + (disbursed_amount >= 20000)::INT
       + (disbursed_amount >= 50000)::INT + (disbursed_amount >= 100000)::INT + (disbursed_amount >= 200000)::INT) FROM {{loans}}
    UNION ALL SELECT 'model_monitor', count(DISTINCT apply_time::DATE) FROM {{applications}}"""


def _panels(d):
    pred, rep = _logs(d)
    return P.dashboard(
        d.customers, d.loan_history, risk_tier(d.scored), pred, rep, "1996-03-20"
    )


@query("G1", PANELS)
def dashboard_panels(d):
    from functools import reduce

    parts = [
        df.groupBy(F.lit(name).alias("report")).agg(F.count(F.lit(1)).alias("n"))
        for name, df in _panels(d).items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "G2 T6 J7",
    """
    SELECT heat, count(*) AS areas, '2024-01-01 08:05' AS taken FROM (
      SELECT area_id, CASE WHEN avg(loan_default) >= 0.10 THEN 'red' WHEN avg(loan_default) >= 0.05 THEN 'yellow' ELSE 'green' END AS heat
      FROM {customers} GROUP BY 1) x GROUP BY 1""",
)
def dashboard_look_back(d):
    """Three snapshots are written; the one in force at 08:07 is read back."""
    root = f"{shared_dir(d.spark)}/snapshots-{uuid4().hex}"
    heat = P.area_default_rate(d.customers)
    P.snapshot({"area_heat": heat.where("heat = 'red'")}, root, "2024-01-01 08:00:00")
    P.snapshot({"area_heat": heat}, root, "2024-01-01 08:05:00")
    P.snapshot({"area_heat": heat.where("heat = 'green'")}, root, "2024-01-01 08:10:00")
    then = P.dashboard_at(d.spark, root, ["area_heat"], "2024-01-01 08:07:00")["area_heat"]
    return then.groupBy("heat").agg(
        F.count(F.lit(1)).alias("areas"),
        F.date_format(F.max("snapshot_ts"), "yyyy-MM-dd HH:mm").alias("taken"),
    )


@query(
    "T5",
    "SELECT strftime(date_trunc('hour', apply_time), '%Y-%m-%d %H') AS hour, count(*) AS events FROM {applications} GROUP BY 1",
)
def hourly_events(d):
    return P.hourly_events(d.applications, "apply_time").withColumn(
        "hour", F.date_format("hour", "yyyy-MM-dd HH")
    )


# ---- scalar functions ----


@query(
    "F1 F2 F3 F4 F5 E1",
    """
    SELECT customer_id, outstanding / nullif(disbursed, 0) AS debt_ratio, overdue_cnt / nullif(loan_cnt, 0) AS overdue_rate,
           active_cnt / nullif(loan_cnt, 0) AS account_util, installment / nullif(approved * 0.3, 0) AS repay_pressure,
           disbursed / nullif(approved, 0) AS disbursed_approved, active_cnt / nullif(loan_cnt - active_cnt, 0) AS active_inactive
    FROM {accounts}""",
    r6="debt_ratio overdue_rate account_util repay_pressure disbursed_approved active_inactive",
)
def derived_ratios(d):
    cols = ["debt_ratio", "overdue_rate", "account_util", "repay_pressure", "disbursed_approved", "active_inactive"]
    return features.derive(d.accounts).select("customer_id", *cols)


@query(
    "F6 F8",
    "SELECT loan_id, disbursed_amount / nullif(asset_cost, 0) AS ltv, ln(1 + disbursed_amount) AS log_amount FROM {loan_history}",
    r6="ltv log_amount",
)
def loan_to_asset(d):
    return d.loan_history.select(
        "loan_id", ratios.ltv("disbursed_amount", "asset_cost").alias("ltv"),
        ratios.log_amount("disbursed_amount").alias("log_amount"),
    )


@query(
    "F7",
    """SELECT loan_id, CAST(year(disbursed_date) AS INT) AS year, CAST(quarter(disbursed_date) AS INT) AS quarter,
         CAST(month(disbursed_date) AS INT) AS month, CAST(isodow(disbursed_date) - 1 AS INT) AS weekday FROM {loans}""",
)
def date_parts(d):
    return d.loans.select("loan_id", *dates.date_parts("disbursed_date"))


SCORE_SQL = """greatest(300, least(850, 600 - 50 * log2(greatest(1e-9, least(1 - 1e-9, p)) / (1 - greatest(1e-9, least(1 - 1e-9, p))) / {w})))"""
GRADE_SQL = "CASE WHEN score >= 750 THEN 'excellent' WHEN score >= 650 THEN 'good' WHEN score >= 550 THEN 'fair' ELSE 'poor' END"


@query("F9", f"SELECT customer_id, {SCORE_SQL.format(w='1.0')} AS score FROM {{scored}}", r6="score")
def score_points(d):
    return d.scored.select("customer_id", score("p").alias("score"))


@query(
    "M13 F11 F13",
    f"""SELECT customer_id, score, {GRADE_SQL} AS grade, CASE WHEN score >= 750 THEN 'best rate, highest limit'
          WHEN score >= 650 THEN 'standard rate, standard limit' WHEN score >= 550 THEN 'raised rate, reduced limit'
          ELSE 'guarantee required or reject' END AS policy
        FROM (SELECT customer_id, {SCORE_SQL.format(w='13.0')} AS score FROM {{scored}}) x""",
    r6="score",
)
def scorecard_with_weight(d):
    return scorecard(d.scored.select("customer_id", "p"), weight=13.0).drop("p")


@query(
    "F10 F11 R1",
    """SELECT customer_id, CASE WHEN age >= 50 THEN 'old' WHEN age >= 30 THEN 'middle' WHEN age >= 18 THEN 'young' END AS age_group,
         CASE WHEN credit_score >= 750 THEN 'excellent' WHEN credit_score >= 650 THEN 'good' WHEN credit_score >= 550 THEN 'fair'
              WHEN credit_score IS NOT NULL THEN 'poor' END AS credit_grade FROM {customers}""",
)
def discretized(d):
    from lendmend.operators.rules import discretize

    return discretize(d.customers).select("customer_id", "age_group", "credit_grade")


@query(
    "F12",
    """SELECT customer_id, CASE WHEN p IS NULL THEN NULL WHEN p >= 0.1 THEN 'red' WHEN p >= 0.05 THEN 'yellow' ELSE 'green' END AS heat
       FROM {scored}""",
)
def heat_bands(d):
    return d.scored.select("customer_id", bands.heat("p").alias("heat"))


@query(
    "F14 R2",
    """SELECT customer_id, concat_ws('|', 'work_type:' || work_type, 'age:' || age, 'credit_score:' || credit_score,
          CASE WHEN has_mobile THEN 'has_mobile:true' ELSE 'has_mobile:false' END) AS items FROM {repairable}""",
)
def item_sets(d):
    row = d.repairable.select(
        "customer_id", items(["work_type", "age", "credit_score", "has_mobile"]).alias("items")
    )
    return row.withColumn("items", F.array_join("items", "|"))


@query(
    "F15",
    """SELECT vec_id, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS self_dot,
         list_cosine_similarity(embedding::DOUBLE[], list_transform(range(1, 65), lambda i: i::DOUBLE)) AS to_ramp FROM {embeddings}""",
    r6="self_dot to_ramp",
)
def vector_products(d):
    ramp = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
    return d.embeddings.select(
        "vec_id", vectors.dot("embedding", "embedding").alias("self_dot"),
        vectors.cosine(F.col("embedding"), ramp).alias("to_ramp"),
    )


@query(
    "F16",
    """
    WITH e AS (SELECT asset_cost AS y, CASE WHEN product <> 'P' THEN disbursed_amount END AS yhat,
                      (overdue_cnt > 0)::INT AS label, (rate > 20)::INT AS said FROM {loan_history} WHERE asset_cost IS NOT NULL)
    SELECT sqrt(avg((y - yhat) ** 2)) AS rmse, avg(abs((y - yhat) / y)) AS mape, avg((yhat IS NOT NULL)::INT) AS coverage,
           count(*) FILTER (WHERE label = 1 AND said = 1) / count(*) FILTER (WHERE said = 1) AS precision,
           count(*) FILTER (WHERE label = 1 AND said = 1) / count(*) FILTER (WHERE label = 1) AS recall,
           2.0 * count(*) FILTER (WHERE label = 1 AND said = 1) / (count(*) FILTER (WHERE label = 1) + count(*) FILTER (WHERE said = 1)) AS f1
    FROM e""",
    r2="rmse",
    r6="mape coverage precision recall f1",
)
def error_measures(d):
    e = d.loan_history.where("asset_cost IS NOT NULL").select(
        F.col("asset_cost").alias("y"),
        F.when(F.col("product") != "P", F.col("disbursed_amount")).alias("yhat"),
        (F.col("overdue_cnt") > 0).cast("int").alias("label"),
        (F.col("rate") > 20).cast("int").alias("said"),
    )
    return e.agg(
        metrics.rmse("y", "yhat").alias("rmse"), metrics.mape("y", "yhat").alias("mape"),
        metrics.coverage("yhat").alias("coverage"), metrics.precision("label", "said").alias("precision"),
        metrics.recall("label", "said").alias("recall"), metrics.f1("label", "said").alias("f1"),
    )


@query(
    "F17",
    """SELECT application_id, CAST(json_extract(props, '$.k') AS INT) AS k,
         '{{"application_id":' || application_id || ',"purpose":"' || purpose || '"}}' AS message FROM {applications}""",
)
def json_messages(d):
    return d.applications.select(
        "application_id", payload.decode("props", "k int")["k"].alias("k"),
        payload.encode("application_id", "purpose").alias("message"),
    )


@query(
    "F18",
    """SELECT vec_id, 0.5 * sin(2 * pi() / 5) * (e[1] * e[2] + e[2] * e[3] + e[3] * e[4] + e[4] * e[5] + e[5] * e[1]) AS area,
         least(e[1], e[2], e[3], e[4], e[5]) / greatest(e[1], e[2], e[3], e[4], e[5]) AS roundness
       FROM (SELECT vec_id, list_transform(embedding[1:5]::DOUBLE[], lambda x: 1 + x) AS e FROM {embeddings}) v""",
    r6="area roundness",
)
def polygon_area(d):
    r = [F.lit(1.0) + F.get("embedding", i).cast("double") for i in range(5)]
    return d.embeddings.select(
        "vec_id", vectors.radar_area(r).alias("area"), vectors.roundness(r).alias("roundness")
    )
