"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Generators propose spans with high recall: four base kinds with fixed patterns, and looser ones
(obfuscated addresses, phone numbers without a plus, account and identity numbers). Boosted trees
score every proposal on format and context features; they learn from all matches of the base
patterns, where a checksum or range tells true matches from lookalikes, but for a quarter that is
held out. A threshold calibrated on all of that quarter selects the redactions. Base spans always stay.

The patterns are written so that Java's matcher needs time and stack in proportion to the text:
possessive quantifiers where nothing can be given back, and look-behinds that keep a match from
being tried again inside a run of its own characters.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendmend.llm.common import written

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser generators: name -> (kind of the span, pattern, a character without which it can't match).
LOOSE = {
    "at_email": (
        "email",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?[(\[]?\s?(?i:at)\s?[)\]]\s?[A-Za-z0-9-]{1,63}+"
        r"\s?(?:\.|[(\[]\s?(?i:dot)\s?[)\]])\s?[A-Za-z]{2,}+",
        "t",
    ),
    "plain_phone": ("phone", r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[\x20.-]?(?:[0-9]{2,4}[\x20.-])?|\(0?[0-9]{2,4}\)\x20?|0[0-9]{1,3}[\x20/-])[0-9]{3,4}[\x20.-]?[0-9]{3,5}(?![0-9])", "0"),
    "iban": ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None),
    "identity": ("identity", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
}
KINDS = (*BASE, "account", "identity")
CONTEXT = 24  # characters before a span that its features see
CUTS = 32  # places at most where the trees may cut a feature
PRECISION = 0.95  # asked of the threshold on held-out proposals
SLICE = 128
#: Fixed words of the context features.
HINTS = {
    "mail": r"(?i)e-?mail|contact|write|schreib|courriel|correo",
    "call": r"(?i)tel|phone|call|fon|mobil|m.vil|appel",
    "pay": r"(?i)card|visa|pay|karte|carte|tarjeta|iban|konto",
    "host": r"(?i)\bip\b|host|server|addr|login",
}
FEATURES = [
    "length", "digits", "letters", "spaces", "dashes", "dots", "joined_before", "joined_after", "checksum",
    "largest_part", *HINTS, *(f"is_{k}" for k in KINDS),
]


def _prefix_sums(values: Column) -> Column:
    """Sum of what stands before each element; slices keep the work near linear for long arrays."""
    zero = F.lit(0).cast("long")
    total = lambda xs: F.aggregate(xs, zero, lambda a, b: a + b)
    parts = F.ceil(F.size(values) / SLICE).cast("int")
    sums = F.transform(F.sequence(F.lit(1), parts), lambda k: total(F.slice(values, (k - 1) * SLICE + 1, SLICE)))
    inner = F.transform(
        F.sequence(F.lit(1), parts),
        lambda k: F.transform(
            F.slice(values, (k - 1) * SLICE + 1, SLICE),
            lambda _, i: total(F.slice(sums, F.lit(1), k - 1)) + total(F.slice(values, (k - 1) * SLICE + 1, i)),
        ),
    )
    return F.when(F.size(values) > 0, F.flatten(inner)).otherwise(F.array().cast("array<bigint>"))


def _with_spans(df: DataFrame, name: str, pattern: str, needs: str | None) -> DataFrame:
    """Adds ``name``: array of (start, end, text, before, after) of all matches, left to right."""
    may = F.contains("text", F.lit(needs)) if needs else F.lit(True)
    none = F.array().cast("array<string>")
    m, p, n = f"{name}_m", f"{name}_p", f"{name}_n"
    df = df.withColumn(m, F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split("text", pattern, -1)).otherwise(none))
    lengths = F.transform(F.col(m), lambda x, i: (F.length(x) + F.length(F.get(F.col(p), i))).cast("long"))
    df = df.withColumn(n, lengths).withColumn(n, _prefix_sums(F.col(n)))

    def span(x, i):
        before, after = F.get(F.col(p), i), F.get(F.col(p), i + 1)
        start = F.get(F.col(n), i) + F.length(before)
        return F.struct(
            start.alias("start"), (start + F.length(x)).alias("end"), x.alias("text"),
            F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(1)).alias("after"),
        )

    return df.withColumn(name, F.transform(F.col(m), span)).drop(m, p, n)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _largest_part(x: Column) -> Column:
    """Largest number between the dots; 1000 stands for any with more than three digits."""
    value = lambda p: F.ltrim(p, F.lit("0"))
    number = lambda p: F.when(F.length(value(p)) > 3, 1000).when(value(p) == "", 0).otherwise(value(p).try_cast("int"))
    return F.coalesce(F.array_max(F.transform(F.split(x, r"\."), number)), F.lit(1000))


def _passes(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _largest_part(x) <= 255
    low, high = (12, 19) if kind == "card" else (9, 15)
    fits = F.length(_digits(x)).between(low, high)
    return fits & _luhn(_digits(x)) if kind == "card" else fits


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, found): per document the proposed spans (kind, base, start, end, features)."""
    df = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    given = {name: (name, pattern, {"email": "@", "phone": "+", "ip": "."}.get(name)) for name, pattern in BASE.items()} | LOOSE
    for name, (_, pattern, needs) in given.items():
        df = _with_spans(df, name, pattern, needs)

    def proposal(name, kind):
        def make(x):
            t = x.text
            ok = _passes(name, t) if name in BASE else F.lit(None).cast("boolean")
            count = lambda c: F.length(t) - F.length(F.regexp_replace(t, c, ""))
            values = [
                F.length(t), count("[0-9]"), count("[A-Za-z]"), count(" "), count("-"), count(r"\."),
                F.right(x.before, F.lit(1)).rlike(r"[\w.+-]").cast("int"), x.after.rlike(r"[\w-]").cast("int"),
                _luhn(_digits(t)).cast("int"), F.when(F.contains(t, F.lit(".")), _largest_part(t)).otherwise(0),
                *[x.before.rlike(h).cast("int") for h in HINTS.values()], *[F.lit(int(kind == k)) for k in KINDS],
            ]
            features = F.array(*[F.coalesce(v.cast("float"), F.lit(0.0)) for v in values])
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), ok.alias("base"), x.start.alias("start"), x.end.alias("end"),
                features.cast("array<float>").alias("features"),
            )

        return F.transform(F.col(name), make)

    return df.select("id", "row", F.concat(*[proposal(name, kind) for name, (kind, _, _) in given.items()]).alias("found"))


def _cut(known: DataFrame) -> tuple[Column, dict]:
    """Vector of whether each feature is above each of its cuts, and its metadata.

    The cuts are exact quantiles of all rows: of plain numbers, MLlib would take them from a sample.
    """
    of = [F.concat(F.array(F.min(x)), F.percentile(x, [k / CUTS for k in range(1, CUTS)])) for x in (F.col("features")[i] for i in range(len(FEATURES)))]
    cuts = [sorted(set(values)) for values in known.agg(*[x.alias(n) for x, n in zip(of, FEATURES, strict=True)]).first()]
    above = F.zip_with("features", F.lit(cuts), lambda x, own: F.transform(own, lambda cut: (x > cut).cast("double")))
    n = sum(map(len, cuts))
    return array_to_vector(F.flatten(above)), {"ml_attr": {"attrs": {"binary": [{"idx": i} for i in range(n)]}, "num_attrs": n}}


def _scored(rows: DataFrame, precision: float) -> DataFrame | None:
    """Proposals of no base kind that reach the threshold, with their score ``p``; None without a model."""
    known = rows.where("base is not null").select("features", F.col("base").cast("int").alias("label"), F.xxhash64("row", "start", "kind").alias("h"))
    known = written(known, "pii-known")
    seen = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if min(seen.get(0, 0), seen.get(1, 0)) < 8:
        return None
    held = F.pmod("h", F.lit(4)) == 0
    vector, binary = _cut(known.where(~held))
    known = known.withColumn("vector", vector.alias("vector", metadata=binary))
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=8, maxDepth=3, seed=1).fit(known.where(~held))
    p = vector_to_array("probability")[1]
    bins = model.transform(known.where(held)).groupBy(F.floor(p * 100).alias("bin")).agg(F.sum("label").alias("hit"), F.count("*").alias("n"))
    hit = total = 0
    threshold = 1.01
    for r in sorted(bins.collect(), key=lambda r: -r.bin):  # at most 101 rows
        hit, total = hit + r.hit, total + r.n
        if hit >= precision * total:
            threshold = r.bin / 100
    loose = rows.where("base is null").withColumn("vector", vector)
    return model.transform(loose).withColumn("p", p).where(F.col("p") >= threshold).select("row", "kind", "start", "end", "p")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """(id, base, spans): per document two arrays of (start, kind, end), by start and then kind.

    ``start`` and ``end`` count code points, ``end`` is exclusive, ``kind`` is a place in ``KINDS``.
    ``base`` has the matches of the base patterns that pass their check; ``spans`` has those and
    the accepted proposals: a proposal that overlaps a base span, or a better accepted proposal,
    is left out. Null texts count as empty, repeated rows and null ids stay, an empty table gives no
    rows. If fewer than eight true or false base matches exist, no trees are fitted and only base
    spans are returned. Every proposal of a base kind is used, for fitting or for the threshold.
    """
    found = written(proposals(docs, id_col, text_col), "pii-proposals")
    base = F.filter("found", lambda x: F.coalesce(x.base, F.lit(False)))
    short = F.array_sort(F.transform(base, lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"))))
    rows = found.select("row", F.explode("found").alias("x")).select("row", "x.*")
    scored = _scored(rows, precision)
    out = found.select("id", "row", short.alias("base"))
    if scored is None:
        return out.select("id", "base", F.col("base").alias("spans"))
    more = scored.groupBy("row").agg(F.collect_list(F.struct("p", "start", "kind", "end")).alias("more"))
    out = out.join(more, "row", "left")
    overlap = lambda x, y: (x.start < y.end) & (y.start < x.end)
    rank = lambda x: F.struct(-x.p, x.start, -x.end, x.kind)
    free = F.filter("more", lambda x: ~F.exists("base", lambda y: overlap(x, y)))
    out = out.withColumn("more", F.coalesce(free, F.array().cast("array<struct<p:double,start:bigint,kind:int,end:bigint>>")))
    best = F.filter("more", lambda x: ~F.exists("more", lambda y: overlap(x, y) & (rank(y) < rank(x))))
    added = F.transform(best, lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end")))
    return out.select("id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x.kind + 1), x.start.cast("string"), x.end.cast("string"))), ","
    )


def redacted(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; ids must be unique and not null."""
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = found.select(F.col("id").alias(id_col), F.array_sort("spans").alias("_spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    end = F.length(text).cast("long")
    # What stands before each span, then its label; overlapping spans merge into the first label.
    done = F.aggregate(
        "_spans",
        F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at")),
        lambda a, x: F.struct(
            F.when(
                x.start >= a.at,
                F.concat(a.parts, F.array(text.substr((a.at + 1).cast("int"), (x.start - a.at).cast("int")), F.concat(F.lit("["), F.element_at(names, x.kind + 1), F.lit("]")))),
            ).otherwise(a.parts).alias("parts"),
            F.greatest(a.at, x.end).alias("at"),
        ),
        lambda a: F.concat(F.array_join(a.parts, ""), text.substr((a.at + 1).cast("int"), end.cast("int"))),
    )
    return docs.join(spans, id_col).withColumn(text_col, done).select(*docs.columns)
