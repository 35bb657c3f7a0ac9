"""Per-key newest rows and trailing sums that hold up when one key has a third of all rows.

``row_number() <= k`` needs no special care: Spark prunes each map task to the first k rows
of a key before the shuffle. Trailing sums are differences of running totals: time is cut into
ranges of about equal numbers of instants, the ranges of a key run in parallel, and their totals
tie them together. The work grows with the rows, however many of them lie inside one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendmend.operators.ranked import default_ranges, in_ranges, range_edges

MONEY = "decimal(38,6)"  # exact sums: differences of large totals lose no cents


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key under ``order``; give enough columns to break ties."""
    return top_per_key(df, keys, order, 1)


def trailing(
    df: DataFrame,
    key: str,
    ts: str,
    spans: dict[str, str],
    amount: str | None = None,
    include_current: bool = False,
    previous: str | None = None,
) -> DataFrame:
    """Count (and sum of ``amount``) of the key's rows in [ts - span, ts).

    ``spans`` maps a suffix to an interval such as ``{"3m": "3 MONTH"}``; months are calendar
    months. Rows of the same instant do not count, unless ``include_current`` is set, which
    counts all of them. Adds ``cnt_<suffix>`` and ``amt_<suffix>``, and as ``previous`` the key's
    latest earlier instant (null for the first). Amounts are summed to six decimals. A row with a
    null key or a null time has no history: its counts and amounts are 0.
    """
    from lendmend.sources.zones import written

    amt = F.coalesce(F.col(amount) if amount else F.lit(0.0), F.lit(0.0)).cast(MONEY)
    known = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    instants = known.groupBy(key, ts).agg(F.count(F.lit(1)).alias("_n"), F.sum(amt).cast(MONEY).alias("_a"))
    instants = written(instants, "instants")
    # kind 0 = question, 1 = fact: a question sees only facts strictly before it, except that
    # the question for the end of an inclusive window comes after its own instant.
    probes = [("_end", F.col(ts), 2 if include_current else 0)]
    probes += [(name, F.expr(f"`{ts}` - INTERVAL {span}"), 0) for name, span in spans.items()]
    if previous:
        probes.append(("_previous", F.col(ts), 0))
    asked = instants.select(
        key,
        F.col(ts).alias("_own"),
        F.explode(
            F.array(*[F.struct(F.lit(w).alias("w"), t.alias("t"), F.lit(k).alias("k")) for w, t, k in probes])
        ).alias("p"),
    ).select(
        key, F.col("p.t").alias("_t"), F.col("p.k").alias("_kind"), F.col("p.w").alias("_w"), "_own",
        F.lit(0).cast("bigint").alias("_n"), F.lit(0).cast(MONEY).alias("_a"),
    )
    facts = instants.select(
        key, F.col(ts).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_w"),
        F.col(ts).alias("_own"), "_n", "_a",
    )
    line = _by_time(facts.unionByName(asked), "_t", _time_edges(instants, ts))
    line = line.withColumn("_last", F.when(F.col("_kind") == 1, F.col("_t")))
    parts = line.groupBy(key, "_range").agg(
        F.sum("_n").alias("_dn"), F.sum("_a").alias("_da"), F.max("_last").alias("_dl")
    )
    # A key has at most MAX_RANGES parts.
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        key, "_range", F.sum("_dn").over(before).alias("_pn"), F.sum("_da").over(before).alias("_pa"),
        F.max("_dl").over(before).alias("_pl"),
    )
    within = W.partitionBy(key, "_range").orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, -1)
    total = lambda own, part: F.coalesce(own, F.lit(0)) + F.coalesce(part, F.lit(0))
    told = (
        line.withColumns(
            {"_rn": F.sum("_n").over(within), "_ra": F.sum("_a").over(within), "_rl": F.max("_last").over(within)}
        )
        .where(F.col("_w").isNotNull())
        .join(parts, [key, "_range"])
        .withColumns(
            {
                "_cn": total(F.col("_rn"), F.col("_pn")), "_ca": total(F.col("_ra"), F.col("_pa")),
                "_cl": F.coalesce("_rl", "_pl"),
            }
        )
    )

    def at(w, c):
        return F.max(F.when(F.col("_w") == w, F.col(c)))

    cols = []
    for name in spans:
        cols.append((at("_end", "_cn") - at(name, "_cn")).alias(f"cnt_{name}"))
        if amount:
            cols.append((at("_end", "_ca") - at(name, "_ca")).cast("double").alias(f"amt_{name}"))
    if previous:
        cols.append(at("_previous", "_cl").alias(previous))
    per_instant = told.groupBy(key, F.col("_own").alias(ts)).agg(*cols)
    out = df.join(per_instant, [key, ts], "left")
    # A sum of doubles, as before, where a row has no history.
    filled = {f"cnt_{n}": F.coalesce(f"cnt_{n}", F.lit(0)) for n in spans}
    filled |= {f"amt_{n}": F.coalesce(f"amt_{n}", F.lit(0.0)) for n in spans if amount}
    added = [c for c in out.columns if c not in df.columns]
    return out.withColumns(filled).select(*df.columns, *added)


def previous_instant(df: DataFrame, key: str, ts: str, out: str = "previous_ts") -> DataFrame:
    """The key's latest earlier instant, null for the first and where the key or the time is null."""
    return trailing(df, key, ts, {}, previous=out)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")).cast("double")


def _time_edges(instants: DataFrame, ts: str) -> list[float]:
    spark = instants.sparkSession
    return range_edges(instants.select(_micros(ts).alias("_us")), "_us", default_ranges(spark))


def _by_time(df: DataFrame, ts: str, edges: list[float]) -> DataFrame:
    return in_ranges(df.withColumn("_us", _micros(ts)), "_us", edges).drop("_us")
