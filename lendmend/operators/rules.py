"""Repair of categories by association rules."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendmend.functions.bands import age_group, grade
from lendmend.functions.items import item_attr, item_value, items

KEY = "customer_id"
RULE_SCHEMA = (
    "target string, antecedent array<string>, value string, confidence double, lift double, "
    "support double"
)


def discretize(df: DataFrame, bands: dict[str, Column] | None = None) -> DataFrame:
    """Continuous columns to bands; categories stay as they are.

    ``bands`` maps a new column to its expression.
    """
    if bands is None:
        bands = {"age_group": age_group("age"), "credit_grade": grade("credit_score")}
    return df.withColumns(bands)


def transactions(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumn("items", items(cols))


def _mined(df: DataFrame, cols: list[str], target: str, support: float, confidence: float):
    present = df.where(F.col(target).isNotNull())
    return FPGrowth(
        itemsCol="items", minSupport=support, minConfidence=confidence
    ).fit(transactions(present, cols).select("items"))


def frequent_items(
    df: DataFrame, cols: list[str], target: str, min_support: float = 0.1
) -> DataFrame:
    """(items, freq): item sets held by at least ``min_support`` of the rows that have ``target``."""
    sets = _mined(df, cols, target, min_support, 1.0).freqItemsets
    return sets.select(F.sort_array("items").alias("items"), "freq")


def rules(
    df: DataFrame,
    cols: list[str],
    targets: list[str],
    min_support: float | dict[str, float] = 0.1,
    min_confidence: float = 0.6,
) -> DataFrame:
    """Rules that conclude a value of one of ``targets``.

    Each target is mined on the rows where it is present: rows without it would count against
    every rule. A value rarer than the support can never be concluded; give such a target its
    own support by passing a dict.
    """
    parts = []
    for t in targets:
        s = min_support.get(t, 0.1) if isinstance(min_support, dict) else min_support
        found = _mined(df, cols, t, s, min_confidence).associationRules
        then = F.col("consequent")[0]
        parts.append(
            found.where(item_attr(then) == t).select(
                F.lit(t).alias("target"),
                F.sort_array("antecedent").alias("antecedent"),
                item_value(then).alias("value"),
                "confidence",
                "lift",
                "support",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def missing_cells(df: DataFrame, cols: list[str], targets: list[str], key: str = KEY) -> DataFrame:
    """(key, items, target): one row per missing target of a record."""
    gaps = F.array_compact(
        F.array(*[F.when(F.col(t).isNull(), F.lit(t)) for t in targets])
    )
    return transactions(df, cols).select(key, "items", F.explode(gaps).alias("target"))


def match_rules(cells: DataFrame, rule_table: DataFrame) -> DataFrame:
    """All rules that apply to each missing cell.

    A rule must conclude the cell's target, and its antecedent must be part of the items. The
    join runs on the target and the antecedent's rarest item among the cells, so a frequent item
    brings no rule to a record that lacks the others.
    """
    often = cells.select(F.explode("items").alias("_lead")).groupBy("_lead").agg(
        F.count(F.lit(1)).alias("_n")
    )
    numbered = rule_table.withColumn("_lead", F.explode("antecedent")).join(often, "_lead", "left")
    rarest = F.min_by("_lead", F.struct(F.coalesce("_n", F.lit(0)), "_lead"))
    led = numbered.groupBy(*rule_table.columns).agg(rarest.alias("_lead"))
    known = cells.withColumn("_lead", F.explode("items"))
    return (
        known.join(led, ["target", "_lead"])
        .where(F.forall("antecedent", lambda a: F.array_contains("items", a)))
        .drop("_lead")
    )


def best_rule(candidates: DataFrame, key: str = KEY) -> DataFrame:
    """The best applicable rule of each cell: confidence, lift, support, then text.

    A minimum, so candidates are combined before they are shuffled and never ranked.
    """
    rank = F.struct(
        (-F.col("confidence")).alias("c"), (-F.col("lift")).alias("l"), (-F.col("support")).alias("s"),
        F.array_join("antecedent", "|").alias("a"), F.col("value").alias("v"), F.col("antecedent").alias("needs"),
    )
    return candidates.groupBy(key, "target").agg(F.min(rank).alias("r")).select(
        key, "target", F.col("r.needs").alias("antecedent"), F.col("r.v").alias("value"),
        (-F.col("r.c")).alias("confidence"),
    )


def repair_by_rule(
    df: DataFrame, rule_table: DataFrame, targets: list[str], cols: list[str], key: str = KEY
) -> DataFrame:
    """(key, feature, value, method, confidence, evidence) of every cell a rule could fill.

    Cells without an applicable rule do not appear: they stay missing.
    """
    best = best_rule(match_rules(missing_cells(df, cols, targets, key), rule_table), key)
    return best.select(
        key,
        F.col("target").alias("feature"),
        "value",
        F.lit("rule").alias("method"),
        "confidence",
        F.array_join("antecedent", " & ").alias("evidence"),
    )
