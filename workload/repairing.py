"""Encoders, selection, and repair of missing values."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lendmend.operators import combine as J
from lendmend.operators import encode, factors, features, repair, rules, select
from lendmend.sources.zones import discard, shuffles_freed, written
from workload.base import AS_OF, query

# ---- encoders ----


@query(
    "E2",
    f"""
    SELECT loan_id, CAST(year(disbursed_date) AS INT) AS year, CAST(isodow(disbursed_date) - 1 AS INT) AS weekday,
           count(*) OVER (PARTITION BY customer_id ORDER BY disbursed_date RANGE BETWEEN INTERVAL 6 MONTH PRECEDING AND CURRENT ROW)
           - count(*) OVER (PARTITION BY customer_id ORDER BY disbursed_date RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS cnt_6m,
           date_diff('day', (min(disbursed_date) OVER (PARTITION BY customer_id))::DATE, DATE '{AS_OF}')::INT AS first_loan_days
    FROM {{loans}}""",
)
def time_features(d):
    out = features.time_features(d.loans, AS_OF)
    return out.select("loan_id", "year", "weekday", "cnt_6m", "first_loan_days")


@query(
    "E3",
    """
    WITH t AS (SELECT area_id, count(*) / (sum(count(*)) OVER ()) AS f FROM {loan_history}
               WHERE disbursed_date < TIMESTAMP '1999-01-01' AND area_id <> 7 GROUP BY 1)
    SELECT loan_id, coalesce(f, 0) AS area_id_freq FROM {loan_history} l LEFT JOIN t ON t.area_id = l.area_id""",
    r6="area_id_freq",
)
def frequency_encoding(d):
    """Fitted on the early loans; one area is unseen there."""
    train = d.loan_history.where("disbursed_date < '1999-01-01' AND area_id <> 7")
    model = encode.FrequencyEncoder(["area_id"]).fit(train)
    return model.transform(d.loan_history.select("loan_id", "area_id")).select(
        "loan_id", "area_id_freq"
    )


LEVELS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query("E4", "SELECT loan_id, CAST(5 - CAST(priority[1] AS INT) AS INT) AS priority_level FROM {loans}")
def ordinal_encoding(d):
    return encode.ordinal(d.loans.select("loan_id", "priority"), "priority", LEVELS).drop("priority")


@query(
    "E5",
    """
    WITH f AS (SELECT work_type, row_number() OVER (ORDER BY count(*) DESC, work_type) AS slot FROM {customers} GROUP BY 1)
    SELECT customer_id, slot, CAST(1 AS DOUBLE) AS ones FROM {customers} JOIN f USING (work_type)""",
)
def one_hot_encoding(d):
    rows = d.customers.select("customer_id", "work_type")
    out = encode.one_hot(["work_type"]).fit(rows).transform(rows)
    hot = vector_to_array("work_type_hot")
    return out.select(
        "customer_id", F.array_position(hot, 1.0).alias("slot"),
        F.aggregate(hot, F.lit(0.0), lambda a, x: a + x).alias("ones"),
    )


@query(
    "E6",
    """
    WITH s AS (SELECT avg(balance) AS m1, stddev_samp(balance) AS s1, avg(age) AS m2, stddev_samp(age) AS s2 FROM {customers} WHERE area_id < 20)
    SELECT customer_id, (balance - m1) / s1 AS balance_std, (age - m2) / s2 AS age_std FROM {customers}, s""",
    r6="balance_std age_std",
)
def standardized(d):
    model = encode.scaler(["balance", "age"]).fit(d.customers.where("area_id < 20"))
    return model.transform(d.customers.select("customer_id", "balance", "age")).select(
        "customer_id", "balance_std", "age_std"
    )


@query(
    "E7",
    """
    WITH s AS (SELECT avg(ln(1 + disbursed_amount)) AS m, stddev_samp(ln(1 + disbursed_amount)) AS sd FROM {loans})
    SELECT loan_id, (ln(1 + disbursed_amount) - m) / sd AS disbursed_amount_std FROM {loans}, s""",
    r6="disbursed_amount_std",
)
def log_standardized(d):
    model = encode.log_scaler(["disbursed_amount"]).fit(d.loans)
    return model.transform(d.loans.select("loan_id", "disbursed_amount")).drop("disbursed_amount")


CANDIDATES = ["overdue_cnt", "active_cnt", "loan_cnt", "outstanding", "disbursed", "balance", "inquiry_cnt",
              "credit_years", "area_id"]


def training_rows(d):
    """Customers with a label and no gaps in the candidate features."""
    flags = [F.col(c).cast("int").alias(c) for c in ("has_mobile", "has_id_card", "has_passport")]
    return d.customers.where("loan_cnt IS NOT NULL").select(
        "customer_id", "loan_default", *CANDIDATES, *flags,
        (F.col("balance") * 0 + 1).alias("constant"),
    )


SELECTABLE = [*CANDIDATES, "has_mobile", "has_id_card", "has_passport", "constant"]


def _each(template, names):
    return " UNION ALL ".join(template.format(c=c) for c in names)


@query(
    "E8",
    "WITH t AS (SELECT * FROM {customers} WHERE loan_cnt IS NOT NULL) "
    + _each(
        "SELECT '{c}' AS feature, CASE WHEN abs(corr({c}, loan_default)) >= 0.05 THEN 'kept' ELSE 'correlation' END AS outcome FROM t",
        CANDIDATES,
    ),
)
def weak_correlation_filter(d):
    got = select.CorrFilter("loan_default").fit(training_rows(d), CANDIDATES)
    return select.selection_report(d.spark, got)


@query(
    "E9",
    "WITH t AS (SELECT *, 1 AS constant FROM {customers} WHERE loan_cnt IS NOT NULL) "
    + _each(
        "SELECT '{c}' AS feature, CASE WHEN var_samp({c}) > 0.01 THEN 'kept' ELSE 'variance' END AS outcome FROM t",
        [*CANDIDATES, "constant"],
    ),
)
def low_variance_filter(d):
    got = select.VarFilter().fit(training_rows(d), [*CANDIDATES, "constant"])
    return select.selection_report(d.spark, got)


def _names(names):
    return ", ".join(f"'{n}'" for n in names)


def outcomes_fit(d, got, allowed):
    """Every feature has one outcome, and it is a known one."""
    report = select.selection_report(d.spark, got)
    return report.groupBy("feature").agg(
        F.count(F.lit(1)).alias("outcomes"), F.every(F.col("outcome").isin(["kept", *allowed])).alias("known")
    )


@query(
    "E10",
    f"SELECT unnest([{_names(CANDIDATES)}]) AS feature, CAST(1 AS BIGINT) AS outcomes, true AS known, CAST(5 AS BIGINT) AS kept",
)
def recursive_elimination(d):
    got = select.RFE("loan_default", 5, step=3, trees=50).fit(training_rows(d), CANDIDATES)
    return outcomes_fit(d, got, set(got.dropped.values())).withColumn("kept", F.lit(len(got.kept)).cast("bigint"))


@query("E11", f"SELECT unnest([{_names(CANDIDATES)}]) AS feature, CAST(1 AS BIGINT) AS outcomes, true AS known, true AS fewer")
def lasso_selection(d):
    """Every feature has an outcome; a stronger penalty keeps no more features."""
    rows = written(training_rows(d), "training")
    got = select.LassoSelector("loan_default", 0.005).fit(rows, CANDIDATES)
    strong = select.LassoSelector("loan_default", 0.05).fit(rows, CANDIDATES)
    return outcomes_fit(d, got, ["lasso"]).withColumn("fewer", F.lit(len(strong.kept) <= len(got.kept)))


@query("E12", f"SELECT unnest([{_names(SELECTABLE)}]) AS feature, CAST(1 AS BIGINT) AS outcomes, true AS known, true AS bounded")
def feature_selection(d):
    """Each dropped feature is recorded once with its step; at most the asked number stays."""
    got = select.select_features(training_rows(d), SELECTABLE, "loan_default", target=6, step=3)
    return outcomes_fit(d, got, set(got.dropped.values())).withColumn("bounded", F.lit(0 < len(got.kept) <= 6))


# ---- association rules ----

ITEM_COLS = ["age_group", "credit_grade", "has_mobile", "has_passport", "work_type"]
TARGETS = ["credit_grade", "has_passport"]


def banded(d):
    bands = {
        "age_group": rules.age_group("age"),
        "credit_grade": rules.grade("credit_score"),
        "has_mobile": F.when(F.col("has_mobile"), "yes").otherwise("no"),
        "has_passport": F.when(
            F.col("customer_id") % 9 != 0, F.when(F.col("has_passport"), "yes").otherwise("no")
        ),
    }
    return rules.discretize(d.repairable, bands).select("customer_id", *ITEM_COLS)


def _cube(src, target):
    """All item sets of the rows that have ``target``, with their counts. Alphabetical columns."""
    cells = ", ".join(f"'{c}:' || {c} AS {c}" for c in ITEM_COLS)
    known = " AND ".join(f"(grouping({c}) = 1 OR {c} IS NOT NULL)" for c in ITEM_COLS)
    return (
        f"(SELECT {', '.join(ITEM_COLS)}, count(*) AS n FROM (SELECT {cells} FROM {src} WHERE {target} IS NOT NULL) i "
        f"GROUP BY CUBE ({', '.join(ITEM_COLS)}) HAVING {known})"
    )


def _rules(src, confidence):
    """(target, antecedent columns, antecedent text, value, confidence, lift, support)"""
    parts = []
    for t in TARGETS:
        rest = [c for c in ITEM_COLS if c != t]
        same = " AND ".join(f"u.{c} IS NOT DISTINCT FROM a.{c}" for c in rest)
        nothing = " AND ".join(f"c.{c} IS NULL" for c in rest)
        some = " OR ".join(f"a.{c} IS NOT NULL" for c in rest)
        cols = ", ".join(f"a.{c} AS ante_{c}" if c != t else f"CAST(NULL AS VARCHAR) AS ante_{c}" for c in ITEM_COLS)
        parts.append(
            f"(WITH s AS MATERIALIZED {_cube(src, t)}, total AS MATERIALIZED (SELECT count(*) AS n FROM {src} WHERE {t} IS NOT NULL)\n"
            f"SELECT '{t}' AS target, {cols}, concat_ws('|', {', '.join('a.' + c for c in rest)}) AS antecedent, "
            f"split_part(u.{t}, ':', 2) AS value, u.n / a.n AS confidence, "
            f"(u.n / a.n) / (c.n / total.n) AS lift, u.n / total.n AS support\n"
            f"FROM s u JOIN s a ON {same} AND a.{t} IS NULL AND ({some}) "
            f"JOIN s c ON c.{t} = u.{t} AND {nothing}, total\n"
            f"WHERE u.{t} IS NOT NULL AND u.n >= ceil(0.1 * total.n) AND u.n / a.n >= {confidence})"
        )
    return " UNION ALL ".join(parts)


def _matches(src, rule_rel):
    on = " AND ".join(f"(r.ante_{c} IS NULL OR r.ante_{c} = '{c}:' || b.{c})" for c in ITEM_COLS)
    gap = " OR ".join(f"(r.target = '{t}' AND b.{t} IS NULL)" for t in TARGETS)
    return (
        f"(SELECT b.customer_id, r.target, r.antecedent, r.value, r.confidence, row_number() OVER "
        f"(PARTITION BY b.customer_id, r.target ORDER BY r.confidence DESC, r.lift DESC, r.support DESC, r.antecedent, r.value) AS rn "
        f"FROM {src} b JOIN {rule_rel} r ON {on} AND ({gap}))"
    )


@query(
    "R3",
    f"""SELECT concat_ws('|', {", ".join(ITEM_COLS)}) AS items, n AS freq FROM {_cube("{banded}", "credit_grade")} s
        WHERE n >= ceil(0.1 * (SELECT count(*) FROM {{banded}} WHERE credit_grade IS NOT NULL))
          AND concat_ws('|', {", ".join(ITEM_COLS)}) <> ''""",
)
def frequent_items(d):
    sets = rules.frequent_items(banded(d), ITEM_COLS, "credit_grade", 0.1)
    return sets.select(F.array_join("items", "|").alias("items"), "freq")


def _rules_by_subset(src, min_support, min_confidence):
    """The rules from one GROUP BY for each target and set of other columns."""
    sets, values = [], []
    for t in TARGETS:
        rest = [c for c in ITEM_COLS if c != t]
        values.append(f"SELECT '{t}' AS target, {t} AS value, count(*) AS n FROM base WHERE {t} IS NOT NULL GROUP BY {t}")
        for some in range(1, 1 << len(rest)):
            own = [c for i, c in enumerate(rest) if some >> i & 1]
            text = " || '|' || ".join(f"'{c}:' || {c}" for c in own)
            known = " AND ".join(f"{c} IS NOT NULL" for c in [*own, t])
            sets.append(f"SELECT '{t}' AS target, {text} AS antecedent, {t} AS value, count(*) AS n FROM base WHERE {known} GROUP BY {', '.join([*own, t])}")
    both = " UNION ALL "
    return f"""WITH base AS (SELECT {", ".join(ITEM_COLS)} FROM {src}),
        sets AS ({both.join(sets)}),
        vals AS ({both.join(values)}),
        whole AS (SELECT target, sum(n) AS n FROM vals GROUP BY target),
        parts AS (SELECT target, antecedent, sum(n) AS n FROM sets GROUP BY target, antecedent)
        SELECT s.target, s.antecedent, s.value, s.n / p.n AS confidence, (s.n / p.n) / (v.n / w.n) AS lift, s.n / w.n AS support
        FROM sets s JOIN parts p ON p.target = s.target AND p.antecedent = s.antecedent
        JOIN vals v ON v.target = s.target AND v.value = s.value JOIN whole w ON w.target = s.target
        WHERE s.n >= ceil({min_support} * w.n) AND s.n / p.n >= {min_confidence}"""


@query(
    "R4",
    _rules_by_subset("{banded}", 0.1, 0.4),
    r6="confidence support",
    r4="lift",
)
def association_rules(d):
    found = rules.rules(banded(d), ITEM_COLS, TARGETS, 0.1, 0.4)
    return found.withColumn("antecedent", F.array_join("antecedent", "|"))


def _rule_table(d, df):
    return written(rules.rules(df, ITEM_COLS, TARGETS, 0.1, 0.4), "rules")


@query(
    "J3",
    f"""WITH r AS ({_rules("{banded}", 0.4)})
        SELECT target, value, antecedent, count(*) AS records FROM {_matches("{banded}", "r")} m GROUP BY 1, 2, 3""",
)
def matching_rules(d):
    df = banded(d)
    cells = rules.missing_cells(df, ITEM_COLS, TARGETS)
    hits = rules.match_rules(cells, _rule_table(d, df))
    return hits.groupBy("target", "value", F.array_join("antecedent", "|").alias("antecedent")).agg(
        F.count(F.lit(1)).alias("records")
    )


BEST = f"""WITH r AS ({_rules("{banded}", 0.4)})
    SELECT customer_id, target AS feature, value, confidence, replace(antecedent, '|', ' & ') AS evidence
    FROM {_matches("{banded}", "r")} m WHERE rn = 1"""


@query("R5 W5", BEST, r6="confidence")
def repair_by_rule(d):
    df = banded(d)
    return rules.repair_by_rule(df, _rule_table(d, df), TARGETS, ITEM_COLS).drop("method")


@query("R5 W5", BEST, r6="confidence")
def repair_by_rule_many_rules(d):
    """With many rules that apply to nothing beside those that do."""
    df = banded(d)
    table = _rule_table(d, df)
    copies = table.withColumn("id", F.explode(F.sequence(F.lit(1), F.lit(500))))
    idle = copies.withColumn(
        "antecedent", F.array_append("antecedent", F.concat(F.lit("nothing:"), F.col("id")))
    )
    got = rules.repair_by_rule(df, table.unionByName(idle.drop("id")), TARGETS, ITEM_COLS)
    return got.drop("method")


def _draw(feature, seed=0):
    return f"('0x' || substr(md5(customer_id || '|{feature}|{seed}'), 1, 8))::BIGINT % 100 < 20"


MASKED = f"""full_rows AS (SELECT * FROM {{banded}} WHERE credit_grade IS NOT NULL AND has_passport IS NOT NULL),
    masked AS (SELECT customer_id, age_group, work_type, has_mobile,
                 CASE WHEN NOT ({_draw("credit_grade")}) THEN credit_grade END AS credit_grade,
                 CASE WHEN NOT ({_draw("has_passport")}) THEN has_passport END AS has_passport FROM full_rows),
    hidden AS (SELECT customer_id, 'credit_grade' AS feature, credit_grade AS truth FROM full_rows WHERE {_draw("credit_grade")}
               UNION ALL SELECT customer_id, 'has_passport', has_passport FROM full_rows WHERE {_draw("has_passport")})"""


@query("R10", f"WITH {MASKED} SELECT feature, truth, count(*) AS n FROM hidden GROUP BY 1, 2")
def masked_cells(d):
    df = banded(d)
    _, hidden = repair.mask(df, TARGETS)
    truth = repair.to_cells(df, TARGETS).withColumnRenamed("value", "truth")
    return hidden.join(truth, ["customer_id", "feature"]).groupBy("feature", "truth").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "R11 J10",
    f"""WITH {MASKED}, r AS ({_rules("masked", 0.4)}),
        best AS (SELECT * FROM {_matches("masked", "r")} m WHERE rn = 1)
        SELECT feature, count(*) AS masked, count(value) AS repaired, count(value) / count(*) AS coverage,
               count(*) FILTER (WHERE value = truth) / count(value) AS accuracy, avg(confidence) AS mean_confidence
        FROM hidden h LEFT JOIN best b ON b.customer_id = h.customer_id AND b.target = h.feature GROUP BY 1""",
    r6="coverage accuracy mean_confidence",
)
def rule_repair_metrics(d):
    df = banded(d)
    masked, hidden = repair.mask(df, TARGETS)
    got = rules.repair_by_rule(masked, _rule_table(d, masked), TARGETS, ITEM_COLS)
    cells = J.masked_truth(got, repair.to_cells(df, TARGETS), hidden)
    return repair.rule_metrics(cells)


# ---- factorisation ----

NUMERIC = ["age", "credit_score", "balance", "loan_cnt", "outstanding", "disbursed"]


@query(
    "R6",
    """
    WITH c AS (SELECT * FROM {customers}),
    s AS (SELECT avg(age) AS m1, stddev_samp(age) AS s1, avg(credit_score) AS m2, stddev_samp(credit_score) AS s2,
                 avg(balance) AS m3, stddev_samp(balance) AS s3 FROM c)
    SELECT 'age' AS feature, count(age) AS cells, max((age - m1) / s1) AS highest, (SELECT count(*) FROM c) AS users FROM c, s
    UNION ALL SELECT 'credit_score', count(credit_score), max((credit_score - m2) / s2), (SELECT count(*) FROM c) FROM c, s
    UNION ALL SELECT 'balance', count(balance), max((balance - m3) / s3), (SELECT count(*) FROM c) FROM c, s""",
    r4="highest",
)
def rating_cells(d):
    r = factors.to_ratings(d.customers, ["age", "credit_score", "balance"])
    ids = r.users.agg((F.max("user") + 1).cast("bigint")).first()[0]
    return r.cells.groupBy(r.feature_of(F.col("item")).alias("feature")).agg(
        F.count(F.lit(1)).alias("cells"), F.max("rating").cast("double").alias("highest")
    ).withColumn("users", F.lit(ids).cast("bigint"))


GAPS = """SELECT customer_id, 'age' AS feature, true AS plausible FROM {customers} WHERE age IS NULL
    UNION ALL SELECT customer_id, 'credit_score', true FROM {customers} WHERE credit_score IS NULL
    UNION ALL SELECT customer_id, unnest(['loan_cnt', 'outstanding', 'disbursed']), true FROM {customers} WHERE loan_cnt IS NULL"""


def plausible(rows, got):
    """Whether repaired numbers lie within the spread of the known ones, widened by its half."""
    bounds = rows.agg(*[F.struct(F.min(f).cast("double").alias("lo"), F.max(f).cast("double").alias("hi")).alias(f) for f in NUMERIC]).first()
    ok = F.lit(False)
    for f in NUMERIC:
        half = (bounds[f]["hi"] - bounds[f]["lo"]) / 2
        ok = F.when(F.col("feature") == f, F.col("value").between(bounds[f]["lo"] - half, bounds[f]["hi"] + half)).otherwise(ok)
    return got.select("customer_id", "feature", F.coalesce(ok, F.lit(False)).alias("plausible"))


@query("R7 R8", GAPS)
def factor_repair(d):
    """Each missing number of each customer, repaired by the factors."""
    rows = d.customers.select("customer_id", *NUMERIC)
    r = factors.to_ratings(rows, NUMERIC)
    model = factors.als_fit(r, rank=50, iterations=10)
    return plausible(rows, factors.als_repair(model, factors.empty_cells(rows, r), r))


@query(
    "R8",
    """SELECT 'age' AS feature, count(*) AS cells FROM {customers} WHERE age IS NULL
       UNION ALL SELECT 'credit_score', count(*) FROM {customers} WHERE credit_score IS NULL
       UNION ALL SELECT feature, count(*) FROM (SELECT unnest(['loan_cnt', 'outstanding', 'disbursed']) AS feature
                 FROM {customers} WHERE loan_cnt IS NULL) x GROUP BY 1""",
)
def factor_repair_coverage(d):
    """Every missing number of a customer known to the model gets a value."""
    rows = d.customers.select("customer_id", *NUMERIC)
    r = factors.to_ratings(rows, NUMERIC)
    model = factors.als_fit(r, rank=50, iterations=10)
    got = factors.als_repair(model, factors.empty_cells(rows, r), r)
    return got.where("value IS NOT NULL").groupBy("feature").agg(F.count(F.lit(1)).alias("cells"))


# Eight numbers that mix two known ones; every fifth cell is hidden. What is hidden, SQL knows as well.
MIXED = {f"mix_{i}": (((7 * i) % 11) / 5 - 1, ((7 * i + 3) % 11) / 5 - 1) for i in range(8)}
MIXED_SQL = ", ".join(
    f"100 + 10 * (({a}) * (balance - 4500) / 3100 + ({b}) * ((customer_id * 37) % 551 - 275) / 159) AS {n}" for n, (a, b) in MIXED.items()
)
UNSEEN = "('0x' || substr(md5(customer_id || '|11'), 1, 8))::BIGINT % 100 >= 80"


def mixed(d):
    """(rows with hidden cells, hidden cells, whether the customer is left out of the fit)"""
    x = (F.col("balance") - 4500) / 3100
    y = (F.col("customer_id") * 37 % 551 - 275) / 159
    rows = d.customers.select("customer_id", *[(100 + 10 * (a * x + b * y)).alias(n) for n, (a, b) in MIXED.items()])
    hidden, cells = repair.mask(rows, list(MIXED))
    return rows, written(hidden, "mixed"), cells, repair.percent_draw("customer_id", seed=11) >= 80


@query(
    "R8 R13",
    f"""WITH m AS (SELECT customer_id, {MIXED_SQL} FROM {{customers}}),
        l AS (UNPIVOT m ON {", ".join(MIXED)} INTO NAME feature VALUE truth)
        SELECT customer_id, feature, truth, true AS near FROM l
        WHERE {UNSEEN} AND ('0x' || substr(md5(customer_id || '|' || feature || '|0'), 1, 8))::BIGINT % 100 < 20""",
    r4="truth",
)
def new_customer_repair(d):
    """Hidden numbers of customers that the factors have never seen, folded in from the numbers that are
    left, and whether each is within a spread of the truth (0.3 of it on average)."""
    names = list(MIXED)
    rows, hidden, cells, unseen = mixed(d)
    r = factors.to_ratings(hidden.where(~unseen), names)
    model = factors.als_fit(r, rank=50, iterations=10)
    got = factors.fold_in_repair(factors.fold_in(model, r), hidden, r)
    truth = repair.to_cells(rows, names)
    both = written(J.masked_truth(got, truth, cells.where(unseen)), "folded")
    mean = {x["feature"]: x["rmse_sd"] for x in repair.als_metrics(both).collect()}  # one row per feature
    good = [f for f, e in mean.items() if e is not None and e <= 0.3]
    sd = F.create_map(*[x for f, (_, s) in r.scaler.stats.items() for x in (F.lit(f), F.lit(float(s)))])
    close = F.abs(F.col("repaired") - F.col("truth")) <= sd[F.col("feature")]
    near = F.coalesce(close & F.col("feature").isin(good), F.lit(False))
    return both.select("customer_id", "feature", F.col("truth").cast("double").alias("truth"), near.alias("near"))


@query(
    "R9",
    """SELECT CAST(0 AS BIGINT) AS strangers, true AS most_filled, true AS plausible""",
)
def neighbour_repair(d):
    """Only missing cells are repaired, nearly all of them, within the spread of the known values."""
    with shuffles_freed(d.spark):
        rows = written(d.customers.select("customer_id", *NUMERIC), "customers")
        r = factors.to_ratings(rows, NUMERIC)
        model = factors.als_fit(r, rank=8, iterations=10)
        gaps = written(factors.empty_cells(rows, r), "gaps")
        got = written(plausible(rows, factors.knn_repair(model, gaps, r, k=10)), "repaired")
    discard(rows, r.cells)
    strangers = got.join(gaps, ["customer_id", "feature"], "left_anti").count()
    return got.agg(
        F.lit(strangers).cast("bigint").alias("strangers"),
        (F.count(F.lit(1)) >= 0.9 * gaps.count()).alias("most_filled"), F.every("plausible").alias("plausible"),
    )


@query(
    "R12 J10",
    """
    WITH c AS (SELECT customer_id, area_id, CAST(age AS DOUBLE) AS age, CAST(credit_score AS DOUBLE) AS credit_score
               FROM {customers} WHERE age IS NOT NULL AND credit_score IS NOT NULL),
    """
    + f"""h AS (SELECT customer_id, 'age' AS feature, age AS truth FROM c WHERE {_draw("age")}
          UNION ALL SELECT customer_id, 'credit_score', credit_score FROM c WHERE {_draw("credit_score")}),
    g AS (SELECT area_id, avg(CASE WHEN NOT ({_draw("age")}) THEN age END) AS age,
                 avg(CASE WHEN NOT ({_draw("credit_score")}) THEN credit_score END) AS credit_score FROM c GROUP BY 1),
    x AS (SELECT feature, truth, CASE WHEN g.area_id <> 3 THEN CASE feature WHEN 'age' THEN g.age ELSE g.credit_score END END AS repaired
          FROM h JOIN c USING (customer_id) JOIN g ON g.area_id = c.area_id)
    SELECT feature, count(*) AS masked, count(repaired) / count(*) AS coverage, sqrt(avg((truth - repaired) ** 2)) AS rmse,
           avg(abs((truth - repaired) / truth)) AS mape, CAST(0 AS BIGINT) AS zero_truth,
           sqrt(avg((truth - repaired) ** 2)) / stddev_samp(truth) AS rmse_sd FROM x GROUP BY 1""",
    r6="coverage rmse mape rmse_sd",
)
def number_repair_metrics(d):
    """Masked cells repaired by the mean of the area, so SQL can follow; one area has no repair."""
    cols = ["age", "credit_score"]
    rows = d.customers.select("customer_id", "area_id", *[F.col(c).cast("double").alias(c) for c in cols])
    masked, hidden = repair.mask(rows, cols)
    means = masked.groupBy("area_id").agg(*[F.avg(c).alias(c) for c in cols]).where("area_id <> 3")
    got = rows.select("customer_id", "area_id").join(means, "area_id")
    cells = J.masked_truth(
        repair.to_cells(got, cols), repair.to_cells(rows, cols), hidden
    )
    return repair.als_metrics(cells)


def repair_input(d):
    """The rows to repair, written once: the views below them shuffle all line items."""
    with shuffles_freed(d.spark):
        return written(_repair_input(d), "repair-input")


def _repair_input(d):
    return banded(d).join(d.customers.select("customer_id", *NUMERIC), "customer_id")


def fitted_repair(rows, check_share=0.0):
    return repair.fit_repair(
        rows, TARGETS, NUMERIC, ITEM_COLS, 0.1, 0.4, rank=50, iterations=10,
        check_share=check_share,
    )


@query(
    "R13",
    """SELECT customer_id, age AS known_age, CAST((age IS NULL)::INT + (credit_score IS NULL)::INT + (balance IS NULL)::INT + (loan_cnt IS NULL)::INT
              + (outstanding IS NULL)::INT + (disbursed IS NULL)::INT AS BIGINT) AS by_factors, true AS told
       FROM {banded} JOIN {customers} c USING (customer_id)""",
)
def repaired_customers(d):
    """Known values stay, every missing number is filled, and each repair tells its confidence."""
    given = repair_input(d)
    out = fitted_repair(given, check_share=0.2).repair(given)
    was = given.select("customer_id", F.col("age").alias("known_age"))
    by_factors = F.coalesce(F.size(F.filter("repairs", lambda r: r.method == "als")), F.lit(0)).cast("bigint")
    kept = F.col("known_age").isNull() | (F.col("known_age") == F.col("age"))
    told = F.coalesce(F.forall("repairs", lambda r: r.confidence.between(0, 1)), F.lit(True))
    return out.join(was, "customer_id").select("customer_id", "known_age", by_factors.alias("by_factors"), (kept & told).alias("told"))


@query(
    "R14",
    """SELECT unnest(['rule', 'rule', 'als', 'als', 'als', 'als', 'als', 'als']) AS method,
              unnest(['credit_grade', 'has_passport', 'age', 'balance', 'credit_score', 'disbursed', 'loan_cnt', 'outstanding']) AS feature,
              true AS measured""",
)
def method_comparison(d):
    """Each method is measured on each of its features: coverage, and accuracy or error."""
    rows = repair_input(d)
    features_ = [*TARGETS, *NUMERIC]
    masked, hidden = repair.mask(rows, features_)
    truth = repair.to_cells(rows, features_)
    table = _rule_table(d, masked)
    by_rule = rules.repair_by_rule(masked, table, TARGETS, ITEM_COLS)
    r = factors.to_ratings(masked, NUMERIC)
    model = factors.als_fit(r, rank=50, iterations=10)
    by_als = factors.als_repair(model, factors.empty_cells(masked, r), r)

    def checked(got, names):
        return J.masked_truth(got, truth, hidden.where(F.col("feature").isin(names)))

    got = repair.compare_methods({"rule": checked(by_rule, TARGETS), "als": checked(by_als, NUMERIC)})
    seen = F.when(F.col("method") == "rule", (F.col("coverage") == 0) | F.col("accuracy").between(0, 1)).otherwise(F.col("rmse") >= 0)
    return got.select("method", "feature", (F.col("coverage").between(0, 1) & seen).alias("measured"))


@query(
    "R15",
    f"""WITH r AS ({_rules("{banded}", 0.4)})
       SELECT customer_id, feature, 'als' AS method, CAST(NULL AS VARCHAR) AS answer, CAST(NULL AS DOUBLE) AS rule_confidence, true AS sure FROM (
         SELECT customer_id, unnest(['age', 'credit_score', 'balance', 'loan_cnt', 'outstanding', 'disbursed']) AS feature,
                unnest([age IS NULL, credit_score IS NULL, balance IS NULL, loan_cnt IS NULL, outstanding IS NULL, disbursed IS NULL]) AS gap
         FROM {{banded}} JOIN {{customers}} c USING (customer_id)) x WHERE gap
       UNION ALL
       SELECT customer_id, target, 'rule', value, confidence, true FROM {_matches("{banded}", "r")} m WHERE rn = 1""",
    r6="rule_confidence",
)
def repair_answers(d):
    """Answers for every missing number, each with a measured confidence, and the answers of the rules."""
    given = repair_input(d)
    got = repair.repair_request(fitted_repair(given, check_share=0.2), given)
    sure = F.coalesce(F.col("confidence").between(0, 1), F.lit(False)) & F.col("value").isNotNull()
    by_rule = F.col("method") == "rule"
    return got.select(
        "customer_id", "feature", "method", F.when(by_rule, F.col("value")).alias("answer"),
        F.when(by_rule, F.col("confidence")).alias("rule_confidence"), sure.alias("sure"),
    )


@query(
    "R16",
    """SELECT customer_id, CAST(m AS INT) AS missing_features, 'unrepaired: too few known features' AS reason FROM (
         SELECT customer_id, (age IS NULL)::INT + (credit_score IS NULL)::INT + (area_id < 5)::INT AS m FROM {customers}) x
       WHERE m / 3.0 > 0.5""",
)
def cold_start_customers(d):
    rows = d.customers.select(
        "customer_id", "age", "credit_score",
        F.when(F.col("area_id") >= 5, F.col("balance")).alias("balance"),
    )
    return repair.cold_start_report(rows, ["age", "credit_score", "balance"])
