"""Typing, range rules, quarantine, deduplication and missing-value marks.

Everything but ``dedup_latest`` is a narrow projection and fuses into one stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendmend.operators.keyed import latest_per_key
from lendmend.schema import Rules

TEXT_NULLS = ("",)


def typed(df: DataFrame, dictionary: dict[str, str]) -> DataFrame:
    """Cast text by dictionary. ``cast_errors`` lists the columns whose text did not convert.

    Empty text is a missing value, not an error.
    """
    marks, out = [], {}
    for name, kind in dictionary.items():
        text = F.trim(F.col(name).cast("string"))
        filled = F.when(~text.isin(*TEXT_NULLS), text)
        cast = filled.try_cast(kind)
        out[name] = cast
        if kind != "string":
            marks.append(F.when(filled.isNotNull() & cast.isNull(), F.lit(name)))
    errors = (
        F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")
    )
    kept = [F.col(c) for c in df.columns if c not in dictionary]
    return df.select(*kept, *[c.alias(n) for n, c in out.items()], errors.alias("cast_errors"))


def age_out_of_range(age: str = "age", rules: Rules = Rules()) -> Column:
    """A missing age is missing, not bad."""
    return F.coalesce(~F.col(age).between(rules.age_low, rules.age_high), F.lit(False))


def flag_age(df: DataFrame, age: str = "age", rules: Rules = Rules()) -> DataFrame:
    return df.withColumn("bad_age", age_out_of_range(age, rules))


def drop_nonpositive_amount(df: DataFrame, amount: str) -> DataFrame:
    """Amounts of zero or less go; a missing amount stays for repair."""
    return df.where((F.col(amount) > 0) | F.col(amount).isNull())


def rate_out_of_range(rate: str = "rate", rules: Rules = Rules()) -> Column:
    r = F.col(rate)
    return F.coalesce((r <= rules.rate_low) | (r > rules.rate_high), F.lit(False))


def flag_rate(df: DataFrame, rate: str = "rate", rules: Rules = Rules()) -> DataFrame:
    return df.withColumn("bad_rate", rate_out_of_range(rate, rules))


def fix_overdue(df: DataFrame, col: str = "overdue_cnt", policy: str = "null") -> DataFrame:
    """Negative overdue counts: to null (then repaired), to their absolute value, or to zero."""
    x = F.col(col)
    fixed = {
        "null": F.lit(None).cast(df.schema[col].dataType),
        "abs": F.abs(x),
        "zero": F.lit(0).cast(df.schema[col].dataType),
    }[policy]
    return df.withColumn(col, F.when(x < 0, fixed).otherwise(x))


def with_reasons(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    marks = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*marks)))


def split_quarantine(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, unfixable rows with their reasons). A row is in exactly one of the two."""
    marked = with_reasons(df, checks)
    good = marked.where(F.size("reasons") == 0).drop("reasons")
    return good, marked.where(F.size("reasons") > 0)


def dedup_latest(
    df: DataFrame,
    keys: tuple[str, ...] = ("customer_id", "apply_time", "disbursed_amount", "term"),
    newest: str = "ingest_ts",
    tie: str = "loan_id",
) -> DataFrame:
    """One row per submission, the newest. Loans of one instant differ in amount or term."""
    order = [F.col(newest).desc_nulls_last(), F.col(tie).desc_nulls_last()]
    return latest_per_key(df, list(keys), order)


def is_missing(df: DataFrame, col: str) -> Column:
    """Null, NaN, or empty text."""
    kind = df.schema[col].dataType.simpleString()
    c = F.col(col)
    if kind in ("double", "float"):
        return c.isNull() | F.isnan(c)
    if kind == "string":
        return c.isNull() | (F.trim(c) == "")
    return c.isNull()


def _missing_total(df: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [is_missing(df, c).cast("int") for c in cols])


def missing_count(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumn("missing_count", _missing_total(df, cols))


def missing_flags(df: DataFrame, key_cols: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": is_missing(df, c) for c in key_cols})


def low_quality(df: DataFrame, cols: list[str], share: float = 0.5) -> DataFrame:
    """More than ``share`` of the fields missing."""
    return df.withColumn(
        "low_quality", _missing_total(df, cols) / F.lit(float(len(cols))) > F.lit(share)
    )


def training_weight(df: DataFrame, weight: float = 0.5) -> DataFrame:
    """Weight column for training. Multiply it with a class weight where there is one."""
    return df.withColumn(
        "training_weight", F.when(F.col("low_quality"), F.lit(float(weight))).otherwise(1.0)
    )


def quality_report(df: DataFrame, cols: list[str], checks: dict[str, Column]) -> DataFrame:
    """Long table (kind, name, n, share) from one pass over the data."""
    aggs = [F.count_if(is_missing(df, c)).alias(f"missing:{c}") for c in cols]
    aggs += [F.count_if(F.coalesce(bad, F.lit(False))).alias(f"rule:{n}") for n, bad in checks.items()]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    names = [c for c in one.columns if c != "rows"]
    long = one.unpivot(["rows"], names, "measure", "n")
    return long.select(
        F.substring_index("measure", ":", 1).alias("kind"),
        F.substring_index("measure", ":", -1).alias("name"),
        "n",
        F.try_divide(F.col("n").cast("double"), F.col("rows")).alias("share"),
    )


def clean_loans(df: DataFrame, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """The whole pass over typed loans: (clean rows, quarantined rows)."""
    kept = drop_nonpositive_amount(df, "disbursed_amount")
    kept = fix_overdue(kept, policy=rules.overdue_policy)
    checks = {"rate": rate_out_of_range(rules=rules)}
    if "age" in df.columns:
        checks["age"] = age_out_of_range(rules=rules)
    if "cast_errors" in df.columns:
        checks["cast"] = F.size("cast_errors") > 0
    good, bad = split_quarantine(kept, checks)
    return dedup_latest(good), bad
