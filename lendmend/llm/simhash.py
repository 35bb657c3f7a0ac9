"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``radius`` bits exactly if some value lies within half the
radius of both. So every fingerprint emits all its variants within half the radius, and those that
share a variant are linked. A variant is dealt by its leading bits: a fingerprint goes once to
every prefix that at most ``radius // 2`` flips reach, with the flips it has left, and the variants
of the other bits are made, deduplicated and verified inside that bucket. Buckets with too many
variants are dealt again by more bits, so no bucket grows with the data.

Near-duplicate removal takes those links as candidates, verifies them by the shingle sets, and adds
the similar texts that are more than ``radius`` bits apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendmend.llm.common import batches_of, components, local_roots, mark, numbered, remove, shuffles_freed, since, written

RADIUS = 4
BUCKET = 500_000  # variants aimed at in one bucket
MOST = 2_000_000  # variants above which a bucket is dealt again
STEP = 8  # bits of one dealing


def shingle_hashes(data: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every ``size``-word shingle of lower-cased text, repeats included."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashed = [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    return np.array(hashed, np.uint64)


def majority(hashes: np.ndarray) -> np.int64:
    """The 64 bits that are set in over half the hashes; no hash: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp long): one SimHash for each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [majority(shingle_hashes(x.as_py() or b"", size)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return given.mapInArrow(run, f"id {kind}, fp long")


def _dealt(rows: DataFrame, bits: int, step: int) -> DataFrame:
    """Each row once for every value of the next ``step`` bits that its flips left can reach."""
    low = 64 - bits - step
    masks = [
        (sum(1 << i for i in flips), n)
        for n in range(RADIUS // 2 + 1)
        for flips in combinations(range(step), n)
    ]
    table = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(n).alias("n")) for m, n in masks])
    own = F.shiftrightunsigned("fp", low).bitwiseAND((1 << step) - 1)
    return rows.select("*", F.explode(F.filter(table, lambda x: x.n <= F.col("left"))).alias("flip")).select(
        "fp",
        (F.col("left") - F.col("flip.n")).alias("left"),
        F.shiftleft("bucket", step).bitwiseOR(own.bitwiseXOR(F.col("flip.m"))).alias("bucket"),
        F.lit(bits + step).alias("bits"),
    )


def _variants(bits: int, flips: int) -> int:
    return sum(comb(64 - bits, n) for n in range(flips + 1))


def _colliding(radius: int):
    half = radius // 2

    def run(group: pa.Table) -> pa.Table:
        bits = group.column("bits")[0].as_py()
        fps = group.column("fp").to_numpy().view(np.uint64)
        left = group.column("left").to_numpy()
        rest = np.uint64((1 << (64 - bits)) - 1) if bits < 64 else np.uint64(0)
        masks = [
            np.array([sum(1 << i for i in x) for n in range(flips + 1) for x in combinations(range(64 - bits), n)], np.uint64)
            for flips in range(half + 1)
        ]
        own = [np.flatnonzero(left == flips) for flips in range(half + 1)]
        total = sum(len(of) * len(m) for of, m in zip(own, masks, strict=True))
        values, owners, at = np.empty(total, np.uint64), np.empty(total, np.int32), 0
        for of, m in zip(own, masks, strict=True):
            part = slice(at, at := at + len(of) * len(m))
            np.bitwise_xor((fps[of] & rest)[:, None], m, out=values[part].reshape(len(of), len(m)))
            owners[part].reshape(len(of), len(m))[:] = of[:, None]
        order = np.argsort(values)
        values = values[order]
        met = np.flatnonzero(values[1:] == values[:-1])
        del values
        pairs = np.stack([owners[order[met]], owners[order[met + 1]]]).astype(np.int64)
        del order, owners
        pairs = np.unique(np.sort(pairs, axis=0), axis=1)
        a, b = pairs[:, np.bitwise_count(fps[pairs[0]] ^ fps[pairs[1]]) <= radius]
        # A star for each component of the bucket, around its best linked member: at most one
        # link for each fingerprint, however dense the bucket is.
        roots = local_roots(len(fps), a, b)
        degree = np.bincount(np.concatenate([a, b]), minlength=len(fps))
        order = np.lexsort((fps, -degree, roots))
        first = order[np.r_[True, roots[order][1:] != roots[order][:-1]]] if len(order) else order
        centre = np.zeros(len(fps), np.int64)
        centre[roots[first]] = first
        centre = centre[roots]
        linked = np.flatnonzero(centre != np.arange(len(fps)))
        return pa.table({"a": fps[linked].view(np.int64), "b": fps[centre[linked]].view(np.int64)})

    return run


def ball_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` at most four bits apart, directly or in steps.

    The input is distinct and written. The links are stars within buckets, so there are far fewer
    than pairs; their components are those of all pairs.
    """
    half = RADIUS // 2
    want = max(0, int(np.ceil(log2(max(1, fps.count() * _variants(0, half) / BUCKET)))))
    rows = fps.select("fp", F.lit(half).alias("left"), F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("bits"))
    bits, ready = 0, []
    while bits < min(want, 56):
        step = min(STEP, want - bits)
        rows, bits = _dealt(rows, bits, step), bits + step
    while True:
        weight = F.when(F.col("left") == 0, 1)
        for n in range(1, half + 1):
            weight = weight.when(F.col("left") == n, _variants(bits, n))
        hot = rows.groupBy("bucket").agg(F.sum(weight).alias("w")).where(F.col("w") > MOST).select("bucket")
        hot = written(hot, "hot-buckets")
        if bits >= 60 or hot.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(hot, "bucket", "left_anti").select(*rows.columns))
        rows = _dealt(rows.join(hot, "bucket", "left_semi").select(*rows.columns), bits, 4)
        bits += 4
    dealt = ready[0]
    for more in ready[1:]:
        dealt = dealt.unionByName(more)
    return dealt.groupBy("bits", "bucket").applyInArrow(_colliding(RADIUS), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp, component): one row per document; ``component`` is the smallest id reachable.

    Null texts count as empty, empty texts have fingerprint zero and are linked like any other.
    Repeated rows stay. Rows with a null id stay and take no part in the smallest id. An empty
    table gives no rows. Only ``id_col`` and ``text_col`` are read.
    """
    own = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = components(written(ball_links(distinct.select("fp")), "ball-links"))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    of = rooted.join(lowest, "root").select("fp", "component")
    return own.join(of, "fp").select("id", "fp", "component")


SIMILARITY = 0.8  # least Jaccard similarity of the shingle sets of near copies
COUNTED = 5_000  # texts whose shingles are counted, to put frequent ones last
FREQUENT = 8  # texts of those that hold a frequent shingle
BINS = 128  # counts of a short text's shingles by hash, which bound what two texts share; longer texts have more
FULL = 255  # largest count that a bin holds
BATCH = 128  # rows with whole texts, or pairs with whole shingle sets, that are handed to Python at once
CENTRES = 16  # members of a bucket that the others are compared with; as many times more each round


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = [xxhash.xxh128_digest(b" ".join((x.as_py() or b"").lower().split())) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(same, pa.binary())], ["id", "row", "same"])


def _shingle_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py() or b"", size)).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.binary())], ["row", "shingles"])

    return run


def _tokens(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("text"):
                found = np.unique(shingle_hashes(x.as_py() or b"", size))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["token"])

    return run


def _bins(n: int) -> int:
    """Bins of a text with ``n`` shingles: a power of two, at most two shingles to a bin.

    With a fixed number the bound of long texts says nothing: full bins overlap by chance.
    """
    return BINS << (n // (2 * BINS)).bit_length()


def _prefixes(size: int, least: float, shared):
    """SimHash of each text, and its first shingles, so many that two similar texts have one of them in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        for batch in batches:
            fps, tokens, sizes, bins = [], [], [], []  # tokens in the order, so that a place is a position
            for x in batch.column("text"):
                hashes = shingle_hashes(x.as_py() or b"", size)
                fps.append(majority(hashes))
                own = np.unique(hashes)
                weight = np.zeros(len(own), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    weight = np.where(frequent[at] == own, counts[at], 0)
                first = np.lexsort((own, weight))[: len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1]
                tokens.append(own[first].view(np.int64))
                sizes.append(len(own))
                width = _bins(len(own))
                counted = np.bincount((own % np.uint64(width)).astype(np.int64), minlength=width)
                bins.append(np.minimum(counted, FULL).astype(np.uint8).tobytes())
            ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*tokens, np.zeros(0, np.int64)])))
            columns = [batch.column("row"), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bins, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["row", "fp", "size", "bins", "tokens"])

    return run


def _possible(least: float):
    """Pairs that their counts do not rule out: a bin's lesser count bounds what is shared there.

    The finer counts are added up to the other text's bins. Texts with a full bin stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
                full = max(x.max(), y.max()) == FULL
                x, y = (c.reshape(-1, min(len(x), len(y))).sum(axis=0, dtype=np.int64) for c in (x, y))
                both = np.minimum(x, y).sum()
                keep.append(bool(full or both >= least * (x.sum() + y.sum() - both) - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _prefix_rows(given: DataFrame, sketched: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(row, fp, size, bins, tokens): every different text's SimHash, counts, and shingles of the prefix; written."""
    every = max(1, -(-texts.count() // COUNTED))
    some = given.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("text").mapInArrow(_tokens(size), "token long")
    # Any one order of all shingles finds the same pairs; the counts only keep buckets small.
    counts = some.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).toPandas()
    frequent = counts["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    shared = given.sparkSession.sparkContext.broadcast((frequent[order], counts["n"].to_numpy(np.int64)[order]))
    copies = sketched.join(texts, sketched.row == texts.lead, "left_anti").select("row")
    copies = written(copies, "same-texts")
    prefixes = given.select("row", "text").mapInArrow(_prefixes(size, similarity, shared), "row long, fp long, size int, bins binary, tokens array<long>")
    return written(prefixes.join(copies, "row", "left_anti"), "prefixes", compression="zstd")


def _ordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _ball_pairs(prefixes: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts with near fingerprints, by ball hashing; those with the same one meet its first text."""
    led = written(prefixes.groupBy("fp").agg(F.min("row").alias("first")), "distinct-fingerprints")
    links = written(ball_links(led.select("fp")), "ball-links")
    of = lambda c: led.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    near = links.join(of("a"), "a").join(of("b"), "b").select(*_ordered("first_a", "first_b"))
    same = prefixes.select("fp", "row").join(led, "fp").where("row <> first").select(*_ordered("row", "first"))
    return near.unionByName(same)


def _unlinked(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that no links connect so far."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    return pairs.where("root_a is null or root_b is null or root_a <> root_b").select("a", "b")


def _asked(pairs: DataFrame) -> DataFrame:
    """The texts of the pairs (a, b); written, so that few of known size are broadcast."""
    rows = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row")))
    return written(rows.distinct(), "asked")


def _verified(given: DataFrame, prefixes: DataFrame, pairs: DataFrame, size: int, similarity: float, roots: DataFrame | None = None) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets are similar enough; written, and all copies on the way deleted.

    Pairs that ``roots`` connect already are left out.
    """
    begin = mark()
    pairs = written(pairs.distinct(), "met")
    if roots is not None:
        pairs = _instead(begin, _unlinked(pairs, roots), "met")
    bins = prefixes.select("row", "bins").join(_asked(pairs), "row", "left_semi")
    counted = pairs.join(bins.select(F.col("row").alias("a"), F.col("bins").alias("x")), "a").join(
        bins.select(F.col("row").alias("b"), F.col("bins").alias("y")), "b"
    )
    pairs = _instead(begin, counted.select("a", "b", "x", "y").mapInArrow(_possible(similarity), "a long, b long"), "proposals")
    sets = given.select("row", "text").join(_asked(pairs), "row", "left_semi").mapInArrow(_shingle_sets(size), "row long, shingles binary")
    sets = written(sets, "shingle-sets")
    met = pairs.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b"
    )
    return _instead(begin, met.select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long, b long"), "similar")


def _instead(begin: int, df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written, and every copy made since ``begin`` deleted."""
    old = since(begin)
    out = written(df, label, **options)
    remove(df.sparkSession, old)
    return out


def _linked(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float, row_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' digests, the different texts, and the root of every linked text; all written.

    First the texts with near fingerprints, found by ball hashing, are verified and linked. Similar
    texts that are more bits apart, or that a bucket of fingerprints linked over others only, are
    found by their prefixes: texts whose prefixes share a shingle are in a bucket, and pairs that
    are not connected yet are compared. In the first round all members meet one
    centre. Buckets whose members are not all linked by then go on with more centres, chosen by
    hash, until all are linked or each member has been a centre: so each pair of a bucket is either
    compared or linked over others, and a bucket of near copies costs one pair for each.

    No pair is made whose sizes rule it out, or the places of the shingle: what two texts share from
    it on cannot be more than either has left, and where they share an earlier one as well, they meet
    in that one's bucket.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(
        F.col(id_col).alias("id"), F.col(row_col).alias("row"), F.col(text_col).cast("binary").alias("text")
    )
    sketched = written(given.mapInArrow(_digests, f"id {kind}, row long, same binary"), "digests")
    # One entry for each different text, led by its first row.
    texts = sketched.groupBy("same").agg(F.min(F.struct("id", "row")).alias("first"))
    texts = written(texts.select("same", "first", F.col("first.row").alias("lead")), "texts")
    first = mark()
    prefixes = _prefix_rows(given, sketched, texts, size, similarity)
    begin = mark()
    links = _verified(given, prefixes, _ball_pairs(prefixes), size, similarity)
    remove(given.sparkSession, since(begin)[:-1])
    begin = mark()
    roots = components(links)
    remove(given.sparkSession, since(begin)[:-1])
    tokens = prefixes.select(F.posexplode("tokens").alias("place", "token"), F.col("row").alias("lead"), "size")
    tokens = tokens.select("token", "lead", "size", "place")

    def fits(a: str, b: str):
        """Whether texts that share a shingle can be similar, by the columns size and place of each."""
        x, y, i, j = (F.col(f"{c}{end}") for c in ("size", "place") for end in (a, b))
        shared = F.least(x - i, y - j)
        return (F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9) & (shared >= similarity * (x + y - shared) - 1e-9)

    # Only the counts go through a shuffle by all shingles; the rest is for those that are shared.
    begin = mark()
    met = written(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "shared-shingles", compression="zstd")
    # ``turn`` says how many centres there have to be until a member is one.
    turn = F.shiftrightunsigned(F.xxhash64("lead"), 11) * F.lit(2.0**-53) * F.col("n")
    buckets = _instead(begin, tokens.join(met, "token").withColumn("turn", turn), "buckets", compression="zstd")
    begin = mark()
    low = buckets.groupBy("token").agg(F.min(F.struct("lead", "size", "place")).alias("low"))
    low = low.select("token", *[F.col(f"low.{c}").alias(f"{c}_low") for c in ("lead", "size", "place")])
    low = written(low, "lowest", compression="zstd")  # Spark splits a hot shingle in a join of tables, not next to an aggregate
    stars = buckets.join(low, "token").where("lead <> lead_low").where(fits("", "_low")).select(*_ordered("lead", "lead_low"))
    links = links.unionByName(_verified(given, prefixes, stars, size, similarity, roots))
    remove(given.sparkSession, since(begin)[:-1])
    buckets = buckets.where("n > 2")  # two members have met by now
    before, until = 0, CENTRES
    while True:
        begin = mark()
        roots = components(links)
        remove(given.sparkSession, since(begin)[:-1])
        rooted = buckets.join(roots, buckets.lead == roots.node, "left").select(*buckets.columns, F.coalesce("root", "lead").alias("root"))
        rooted = written(rooted, "rooted")
        open_ = rooted.where(F.col("n") > before).groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        open_ = written(open_.where("low <> high").select("token"), "open-buckets")
        if open_.isEmpty():
            return sketched, texts, _instead(first, roots, "roots")
        rooted = _instead(begin, rooted.join(open_, "token", "left_semi").where(F.col("turn") >= before), "rooted")
        new = rooted.where(F.col("turn") < until).select("token", *[F.col(c).alias(f"{c}_b") for c in ("lead", "size", "place", "root")])
        pairs = rooted.join(new, "token").where("root <> root_b").where(fits("", "_b")).select(*_ordered("lead", "lead_b"))
        links = links.unionByName(_verified(given, prefixes, pairs, size, similarity))
        buckets = rooted.drop("root")
        before, until = until, until * CENTRES


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    similarity: float = SIMILARITY,
    row_col: str | None = None,
) -> DataFrame:
    """(id, row, group, keep): near copies in groups; one row of each group, with the smallest id, is kept.

    Texts with the same words (ASCII letters lower-cased) are copies. Other texts are linked if the
    Jaccard similarity of their sets of ``size``-word shingles is at least ``similarity``; groups are
    what links connect. Candidates are the texts whose SimHash fingerprints ball hashing links; for
    what its four bits miss, more come from prefixes: with all shingles in one order, two sets that
    similar share one of their first ``n - ceil(similarity * n) + 1``. So no pair is missed.
    ``row`` is the stored row number ``row_col``; without one, rows are numbered in a written copy. Null texts count as empty and are copies of each other; null ids come first.
    An empty table gives no rows.
    """
    if row_col is None:
        docs, row_col = numbered(docs.select(*dict.fromkeys([id_col, text_col]))), "__row"
    with batches_of(docs.sparkSession, BATCH), shuffles_freed(docs.sparkSession):
        sketched, texts, roots = _linked(docs, id_col, text_col, size, similarity, row_col)
    grouped = texts.join(roots, texts.lead == roots.node, "left").select("same", "first", F.coalesce("root", "lead").alias("root"))
    kept = grouped.groupBy("root").agg(F.min("first").alias("kept"))
    of = grouped.join(kept, "root").select("same", "kept")
    return sketched.join(of, "same").select(
        "id", "row", F.col("kept.id").alias("group"), (F.col("row") == F.col("kept.row")).alias("keep")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies; see ``near_duplicates``."""
    rows = numbered(docs)
    begin = mark()
    found = near_duplicates(rows, id_col, text_col, row_col="__row", **options)
    gone = _instead(begin, found.where("not keep").select(F.col("row").alias("__row")), "copies")
    return rows.join(gone.hint("merge"), "__row", "left_anti").select(*docs.columns)
