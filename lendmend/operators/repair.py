"""Routing of repairs by feature type, and their evaluation on masked cells."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendmend.functions import metrics as M
from lendmend.operators.combine import masked_truth
from lendmend.operators.factors import (
    FoldIn,
    Ratings,
    als_fit,
    als_repair,
    empty_cells,
    fold_in,
    fold_in_repair,
    to_ratings,
)
from lendmend.operators.rules import RULE_SCHEMA, repair_by_rule, rules

KEY = "customer_id"
UNSEEN_SEED = 21  # draw of the customers that a check leaves out of the factors


def percent_draw(*cols: str | Column, seed: int = 0) -> Column:
    """0..99, fixed by the values alone, so a re-run task draws the same."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    text = F.concat_ws("|", *parts, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100


def to_cells(df: DataFrame, features: list[str], key: str = KEY) -> DataFrame:
    """(key, feature, value as text) of all present cells."""
    texts = df.select(key, *[F.col(f).cast("string").alias(f) for f in features])
    return texts.unpivot([key], features, "feature", "value").where(F.col("value").isNotNull())


def mask(
    df: DataFrame, features: list[str], share: float = 0.2, seed: int = 0, key: str = KEY
) -> tuple[DataFrame, DataFrame]:
    """(table with ``share`` of the complete rows' cells hidden, list of hidden cells)."""
    complete = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    full = df.where(complete)
    hide = {f: percent_draw(key, F.lit(f), seed=seed) < round(share * 100) for f in features}
    hidden = full.select(
        key,
        F.explode(
            F.array_compact(F.array(*[F.when(h, F.lit(f)) for f, h in hide.items()]))
        ).alias("feature"),
    )
    return full.withColumns({f: F.when(~h, F.col(f)) for f, h in hide.items()}), hidden


def rule_metrics(masked: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Coverage, accuracy of the repaired cells, mean confidence."""
    return masked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("masked"),
        F.count("repaired").alias("repaired"),
        M.coverage("repaired").alias("coverage"),
        M.accuracy("truth", "repaired").alias("accuracy"),
        F.avg(F.when(F.col("repaired").isNotNull(), F.col("confidence"))).alias("mean_confidence"),
    )


def als_metrics(masked: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """RMSE, MAPE (zero truths left out and counted), coverage, RMSE relative to the spread."""
    t, r = F.col("truth").cast("double"), F.col("repaired").cast("double")
    out = masked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("masked"),
        M.coverage(r).alias("coverage"),
        M.rmse(t, r).alias("rmse"),
        M.mape(t, r).alias("mape"),
        M.zero_truth(t, r).alias("zero_truth"),
        F.stddev_samp(t).alias("_sd"),
    )
    return out.withColumn("rmse_sd", F.try_divide("rmse", "_sd")).drop("_sd")


def compare_methods(masked_by_method: dict[str, DataFrame]) -> DataFrame:
    """Rule and matrix measures of every method, by feature."""
    parts = []
    for method, masked in masked_by_method.items():
        if "confidence" not in masked.columns:
            masked = masked.withColumn("confidence", F.lit(None).cast("double"))
        t, r = F.col("truth").try_cast("double"), F.col("repaired").try_cast("double")
        parts.append(
            masked.groupBy("feature")
            .agg(
                M.coverage("repaired").alias("coverage"),
                M.accuracy("truth", "repaired").alias("accuracy"),
                F.avg("confidence").alias("mean_confidence"),
                M.rmse(t, r).alias("rmse"),
                M.mape(t, r).alias("mape"),
            )
            .withColumn("method", F.lit(method))
        )
    return reduce(DataFrame.unionByName, parts)


def cold_start_report(
    df: DataFrame, features: list[str], share: float = 0.5, key: str = KEY
) -> DataFrame:
    """Customers with too few known features for factorisation."""
    n = reduce(lambda a, b: a + b, [F.col(f).isNull().cast("int") for f in features])
    return (
        df.select(key, n.alias("missing_features"))
        .where(F.col("missing_features") / F.lit(float(len(features))) > share)
        .withColumn("reason", F.lit("unrepaired: too few known features"))
    )


@dataclass
class RepairModel:
    """What ``repair`` needs at serving time; fitted once on the training split."""

    categorical: list[str]
    numeric: list[str]
    item_cols: list[str]
    rule_table: DataFrame
    als: ALSModel | None
    ratings: Ratings | None
    confidence: dict[str, float] = field(default_factory=dict)
    folding: FoldIn | None = None
    fold_confidence: dict[str, float] = field(default_factory=dict)

    def cells(self, df: DataFrame, key: str = KEY, customer: str | None = None) -> DataFrame:
        """Repaired cells in long form: value as text, method, confidence, evidence.

        ``key`` identifies a row, ``customer`` (by default the same) its customer. Numbers of a
        customer in the factors are their product (method als); those of any other come from folding
        in the numbers the row has. Confidence is null where it was not measured.
        """
        parts = []
        if self.categorical:
            parts.append(
                repair_by_rule(df, self.rule_table, self.categorical, self.item_cols, key)
            )
        if self.als is not None and self.numeric:
            gaps = empty_cells(df, self.ratings, key, customer)
            filled = als_repair(self.als, gaps, self.ratings, key)
            parts.append(self._told(filled, key, "als", "factor product", self.confidence))
            if self.folding is not None:
                new = fold_in_repair(self.folding, df, self.ratings, key, customer)
                parts.append(self._told(new, key, "fold-in", "factors from the row's own numbers", self.fold_confidence))
        return reduce(DataFrame.unionByName, parts)

    def _told(self, filled: DataFrame, key: str, method: str, evidence: str, measured: dict[str, float]) -> DataFrame:
        conf = F.create_map(*[x for f in self.numeric for x in (F.lit(f), F.lit(measured.get(f)).cast("double"))])
        return filled.select(
            key, "feature", F.col("value").cast("string").alias("value"), F.lit(method).alias("method"),
            F.try_element_at(conf, F.col("feature")).alias("confidence"), F.lit(evidence).alias("evidence"),
        )

    def repair(self, df: DataFrame, key: str = KEY, customer: str | None = None) -> DataFrame:
        """The table with gaps filled; ``repairs`` tells per filled cell how and how surely."""
        features = [*self.categorical, *self.numeric]
        per_row = self.cells(df, key, customer).groupBy(key).agg(
            *[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f"_r_{f}") for f in features],
            F.sort_array(
                F.collect_list(F.struct("feature", "method", "confidence", "evidence"))
            ).alias("repairs"),  # at most one entry per feature
        )
        out = df.join(per_row, key, "left")
        types = {f.name: f.dataType for f in df.schema.fields}

        def filled(f):
            text = F.col(f"_r_{f}")
            if types[f].simpleString() in ("int", "bigint"):
                return F.coalesce(F.col(f), F.round(text.try_cast("double")).cast(types[f]))
            return F.coalesce(F.col(f), text.try_cast(types[f]))

        return out.withColumns({f: filled(f) for f in features}).drop(
            *[f"_r_{f}" for f in features]
        )


def fit_repair(
    train: DataFrame,
    categorical: list[str],
    numeric: list[str],
    item_cols: list[str],
    min_support: float = 0.1,
    min_confidence: float = 0.6,
    rank: int = 50,
    iterations: int = 10,
    key: str = KEY,
    check_share: float = 0.0,
) -> RepairModel:
    """Mine rules for categories and factorise numbers.

    With ``check_share`` some known numeric cells are held back first; 1 - RMSE / spread on them
    becomes the confidence of that feature's repairs. One customer in five is left out of that check's
    factors, and shows how well numbers of new customers are folded in.
    """
    from lendmend.sources.zones import discard, shuffles_freed, written

    with shuffles_freed(train.sparkSession):
        train = written(train, "repair-train")  # mined per target and factorised
    table = train.sparkSession.createDataFrame([], RULE_SCHEMA)
    if categorical:
        table = written(rules(train, item_cols, categorical, min_support, min_confidence), "rules")
    model = RepairModel(categorical, numeric, item_cols, table, None, None)
    if numeric:
        if check_share:
            hidden, cells = mask(train, numeric, check_share, key=key)
            new = percent_draw(key, seed=UNSEEN_SEED) < 20
            r = to_ratings(hidden.where(~new), numeric, key)
            m = als_fit(r, rank, iterations=iterations)
            truth = to_cells(train, numeric, key)

            def surely(got, of):
                seen = als_metrics(masked_truth(got, truth, cells.where(of), key))
                with shuffles_freed(train.sparkSession):
                    rows = seen.collect()  # one row per feature
                return {x["feature"]: max(0.0, 1.0 - x["rmse_sd"]) for x in rows if x["rmse_sd"] is not None}

            model.confidence = surely(als_repair(m, empty_cells(hidden, r, key), r, key), ~new)
            model.fold_confidence = surely(fold_in_repair(fold_in(m, r), hidden, r, key), new)
            discard(r.cells, r.users)
        model.ratings = to_ratings(train, numeric, key)
        model.als = als_fit(model.ratings, rank, iterations=iterations)
        model.folding = fold_in(model.als, model.ratings)
    discard(train)
    return model


def repair_request(model: RepairModel, df: DataFrame, key: str = KEY) -> DataFrame:
    """Answer to a repair request: the repaired cells with their confidence."""
    return model.cells(df, key)
