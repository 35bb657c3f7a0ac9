"""Exact substring dedup with a sampled suffix array, sorted by a distributed merge.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Suffixes are
sampled by content: each string of that length picks the position of its least 8-gram hash among
its first ``REACH`` positions, so equal strings pick equal positions and only picked suffixes need
sorting. Those whose first bytes occur once are left out. The others are sorted in runs, equal ones
combined, front-coded, and exchanged by the hash of their first bytes; each reducer merges its runs
with a loser tree that compares only beyond prefixes known to be common. The common prefixes of
neighbours in merged order, with the bytes left of each suffix, tell which strings repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendmend.llm.common import batches_of, mark, remove, since, written

LENGTH = 200
REACH = 144  # positions among which a string picks; LENGTH - REACH + 1 bytes follow at least
HOT = 20_000  # occurrences above which a first part is dealt by string position too
GROUP_BYTES = 16_000_000  # of suffixes aimed at in one merge group
RUN_BYTES = 12_000_000  # of suffixes sorted in one run
CHUNK = 8192  # suffixes compared at once after merging
BATCH = 1000  # rows with whole texts that are handed to Python at once
PLACE = np.uint64((1 << 28) - 1)
PIECE = 1 << 27


def picked(data: bytes, length: int = LENGTH, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions picked by the strings of ``length`` bytes, with the first and last string of each.

    Position p is picked by the strings that start at ``first`` to ``last``.
    """
    found = []
    for base in range(0, max(1, len(data) - length + 1), PIECE):
        part = data[base : base + PIECE + length - 1]
        n = len(part) - length + 1
        if n < 1:
            continue
        gram = np.ndarray((n + reach - 1,), "<u8", part, 0, (1,))
        key = gram * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key = (key & ~PLACE) | np.arange(len(key), dtype=np.uint64)
        span = 1
        while span < reach:  # least key of the reach positions from each on
            step = min(span, reach - span)
            key = np.minimum(key[:-step], key[step:])
            span += step
        at = (key & PLACE).astype(np.int64)
        change = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        found.append(np.stack([at[change], change, np.r_[change[1:], n] - 1]) + base)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(found, axis=1))


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, text) with the text's size and its compressed bytes, as they are stored and shuffled twice."""
    pack = zstandard.ZstdCompressor().compress
    for batch in batches:
        texts = batch.column(2)
        packed = pa.array([pack(x.as_buffer()) for x in texts], pa.binary())
        size = pc.binary_length(texts).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], size, packed], ["row", "id", "n_bytes", "text"])


def _text(packed: pa.Scalar) -> bytes:
    return zstandard.decompress(packed.as_py())


def _picks(length: int, reach: int):
    sure = length - reach + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[], [], [], [], []]
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = _text(text)
                at, first, last = picked(data, length, reach)
                if len(at):
                    head = [xxhash.xxh64_intdigest(data[p : p + sure]) - (1 << 63) for p in at.tolist()]
                    for c, v in zip(columns, (np.full(len(at), row), at, at - last, at - first, np.array(head)), strict=True):
                        c.append(v)
            if columns[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), k) for c, k in zip(columns, kinds, strict=True)], names
                )

    kinds = [pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64()]
    names = ["row", "at", "near", "far", "head"]
    return run


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, ``start`` bytes of which are known to agree."""
    n = min(len(a), len(b))
    while start + 16 <= n and a[start : start + 16] == b[start : start + 16]:
        start += 16
    while start < n and a[start] == b[start]:
        start += 1
    return start


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Common prefix with the key before, length, and the bytes beyond it, of each key."""
    prefix, rest, before = np.zeros(len(keys), np.uint8), [], b""
    for i, key in enumerate(keys):
        prefix[i] = k = _common(before, key, 0)
        rest.append(key[k:])
        before = key
    return prefix, np.fromiter(map(len, keys), np.uint8, len(keys)), b"".join(rest)


def decoded(prefix: np.ndarray, lengths: np.ndarray, rest: bytes) -> list[bytes]:
    keys, at, before = [], 0, b""
    for k, n in zip(prefix.tolist(), lengths.tolist(), strict=True):
        before = before[:k] + rest[at : at + n - k]
        at += n - k
        keys.append(before)
    return keys


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place, common prefix with the key before) of all keys in order, by a loser tree.

    A run is sorted keys and the common prefix of each with the key before it. Every waiting key's
    common prefix with the last winner is known: the longer one is less, and only equal ones are
    compared, from there on.
    """
    width = 1
    while width < len(runs):
        width *= 2
    heads = [0] * width
    known = [0] * width  # common prefix of a run's head with the last winner
    sizes = [len(runs[i][0]) if i < len(runs) else 0 for i in range(width)]

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        if heads[a] >= sizes[a]:
            return b, a
        if heads[b] >= sizes[b]:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = runs[a][0][heads[a]], runs[b][0][heads[b]]
        k = _common(x, y, known[a])
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    losers = [0] * width

    def build(node: int) -> int:
        if node >= width:
            return node - width
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while heads[winner] < sizes[winner]:
        place = heads[winner]
        yield winner, place, known[winner]
        heads[winner] += 1
        if heads[winner] < sizes[winner]:
            known[winner] = runs[winner][1][heads[winner]]
        node = (winner + width) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeated(prefix, near, far, count, lefts, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which strings repeat, of suffixes in order: (suffix, least and greatest distance).

    A string starts ``d`` bytes left of its suffix, ``near <= d <= far``. Two agree if they have
    ``length - d`` bytes to the right and ``d`` bytes to the left in common.
    """
    n = len(prefix)
    left = np.zeros((n, reach), np.uint8)
    sizes = np.fromiter(map(len, lefts), np.int64, n)
    left[np.arange(reach) < sizes[:, None]] = np.frombuffer(b"".join(lefts), np.uint8)
    hashed = np.full(n, 0x51ED270B, np.uint64)
    hit = np.zeros((n, reach + 2), bool)
    for d in range(reach):  # one distance after the other, so that only ``hit`` has a cell for each
        rows = np.flatnonzero((near <= d) & (d <= far))
        if len(rows):
            right = np.cumsum(prefix < length - d)[rows]
            key = hashed[rows] ^ (right.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            key ^= key >> np.uint64(32)
            key *= np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
            hit[rows, d + 1] = _twice(key, right, left[:, :d], rows) | (count[rows] > 1)
        hashed = (hashed + left[:, d] + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
        hashed ^= hashed >> np.uint64(31)
    starts = np.argwhere(hit[:, 1:] & ~hit[:, :-1])
    ends = np.argwhere(~hit[:, 1:] & hit[:, :-1])
    return starts[:, 0], starts[:, 1], ends[:, 1] - 1


def _twice(key: np.ndarray, right: np.ndarray, left: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of ``rows`` have the right group and the left bytes of another one; keys only bring them together."""
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    a, b = order[same], order[same + 1]
    equal = (right[a] == right[b]) & (left[rows[a]] == left[rows[b]]).all(axis=1)
    out = np.zeros(len(rows), bool)
    if equal.all():
        out[a] = out[b] = True
        return out
    exact = np.concatenate([right.astype(">i8").view(np.uint8).reshape(len(rows), 8), left[rows]], axis=1)
    _, group, n = np.unique(exact, axis=0, return_inverse=True, return_counts=True)
    return n[group.ravel()] > 1


_RUNS = "run long, bucket int, entries binary, prefix binary, sizes binary, rest binary, left_prefix binary, left_sizes binary, left_rest binary, ranges binary, places binary"


def _sorted_runs(length: int, reach: int, buckets: int, hot: int):
    """Sorts the suffixes of a task in runs; one row for each run and bucket, one with the run's places."""
    names = [x.split()[0] for x in _RUNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 32, 0
        found: dict[tuple, list] = {}
        size = 0
        for batch in batches:
            for x in range(batch.num_rows):
                row, data, picks = batch.column(0)[x].as_py(), _text(batch.column(1)[x]), batch.column(2)[x].as_py()
                for p in picks:
                    at, near, far = p["at"], p["near"], p["far"]
                    key = data[at : at + length - near], data[at - far : at][::-1], near, far, p["head"], p["n"] > hot
                    found.setdefault(key, []).append((row, at))
                    size += 300 if len(found[key]) == 1 else 32
                if size > RUN_BYTES:
                    yield from blocks(base + number, found)
                    found, size, number = {}, 0, number + 1
        if found:
            yield from blocks(base + number, found)

    def blocks(number: int, found: dict) -> Iterator[pa.RecordBatch]:
        entries = sorted(found)
        places = np.array([(e, row, at) for e, key in enumerate(entries) for row, at in found[key]], np.int64)
        out: dict[int, list] = {}
        for e, (right, left, near, far, head, is_hot) in enumerate(entries):
            n = min(2, len(found[entries[e]]))
            if is_hot:  # each string of a hot suffix goes its own way
                for d in range(near, far + 1):
                    bucket = xxhash.xxh64_intdigest(left[:d], (head ^ d) & (2**64 - 1)) % buckets
                    out.setdefault(bucket, []).append((right[: length - d], left[:d], d, d, n, e))
            else:
                out.setdefault(head % buckets, []).append((right, left, near, far, n, e))
        rows = []
        for bucket, own in out.items():
            own.sort(key=lambda x: x[0])
            prefix, sizes, rest = front_coded([x[0] for x in own])
            ranges = np.array([x[2:5] for x in own], np.uint8).tobytes()
            numbers = np.array([x[5] for x in own], np.int32).tobytes()
            # Left parts are only front-coded: neighbours in the order of the right parts often agree.
            left_prefix, left_sizes, left_rest = front_coded([x[1] for x in own])
            rows.append((number, bucket, numbers, prefix.tobytes(), sizes.tobytes(), rest, left_prefix.tobytes(), left_sizes.tobytes(), left_rest, ranges, None))
        rows.append((number, -1, None, None, None, None, None, None, None, None, places.tobytes()))
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 9]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _merge_runs(length: int, reach: int):
    sure = length - reach + 1

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        u8 = lambda x: np.frombuffer(x, np.uint8)
        runs, lefts, ranges, numbers = [], [], [], []
        for r in rows:
            prefix = u8(r["prefix"])
            runs.append((decoded(prefix, u8(r["sizes"]), r["rest"]), prefix.tolist()))
            lefts.append(decoded(u8(r["left_prefix"]), u8(r["left_sizes"]), r["left_rest"]))
            ranges.append(u8(r["ranges"]).reshape(-1, 3))
            numbers.append(np.frombuffer(r["entries"], np.int32))
        out, held = [], []

        def flush() -> None:
            if not held:
                return
            of, place, prefix = (np.array(x, np.int64) for x in zip(*held, strict=True))
            prefix[0] = 0
            bounds = np.stack([ranges[k][i] for k, i in zip(of, place, strict=True)]).astype(np.int64)
            left = [lefts[k][i] for k, i in zip(of, place, strict=True)]
            which, low, high = repeated(prefix, bounds[:, 0], bounds[:, 1], bounds[:, 2], left, length, reach)
            own = np.array([numbers[k][i] for k, i in zip(of[which], place[which], strict=True)], np.int64)
            out.append((np.array([rows[k]["run"] for k in of[which]], np.int64), own, low, high))
            held.clear()

        for item in merged(runs):
            if item[2] < sure and len(held) >= CHUNK:
                flush()
            held.append(item)
        flush()
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("run", "entry", "low", "high"), columns, strict=True)})

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = np.frombuffer(places.as_py(), np.int64).reshape(-1, 3)
            for at in range(0, len(found), 1 << 18):
                part = found[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), run)), *[pa.array(part[:, k].copy()) for k in range(3)]], ["run", "entry", "row", "at"]
                )


def repeated_spans(rows: DataFrame, length: int = LENGTH, reach: int = REACH, hot: int = HOT) -> DataFrame:
    """(row, spans): byte ranges that repeated strings cover, not yet merged, of rows (row, text) as ``_compressed`` gives them."""
    if not 8 < reach < length - 8 or length > 255:
        raise ValueError("asks for 8 < reach < length - 8 and length <= 255")
    spark = rows.sparkSession
    picks = rows.mapInArrow(_picks(length, reach), "row long, at int, near short, far short, head long")
    # Written, so that the join below meets two plain exchanges, whose hot keys Spark can split.
    again = written(picks.groupBy("head").agg(F.count("*").alias("n")).where("n > 1"), "repeated-heads")
    shared = picks.join(again, "head").groupBy("row").agg(F.collect_list(F.struct("at", "near", "far", "head", "n")).alias("picks"))
    # As many merge groups as the repeated suffixes need, so that none grows with the input.
    occurrences = again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-occurrences * length // GROUP_BYTES))
    given = rows.join(shared.hint("merge"), "row").select("row", "text", "picks")
    runs = written(given.mapInArrow(_sorted_runs(length, reach, buckets, hot), _RUNS), "suffix-runs", compression="zstd")
    dealt = runs.where("bucket >= 0").drop("places")
    found = dealt.groupBy("bucket").applyInArrow(_merge_runs(length, reach), "run long, entry long, low long, high long")
    places = runs.where("bucket < 0").select("run", "places").mapInArrow(_places, "run long, entry long, row long, at long")
    spans = found.join(places, ["run", "entry"]).select(
        "row", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end")
    )
    return spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, runs = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data = _text(text)
            gone = np.zeros(len(data) + 2, np.int32)
            for s in spans.as_py() or []:
                gone[s["start"] + 1] += 1
                gone[s["end"] + 1] -= 1
            out = np.cumsum(gone)[1:-1] > 0
            kept.append(np.frombuffer(data, np.uint8)[~out].tobytes())
            removed.append(int(out.sum()))
            runs.append(int((np.diff(np.r_[False, out].astype(np.int8)) == 1).sum()))
        keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("text", "spans")]
        names = [n for n in batch.schema.names if n not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
            [*names, "kept", "n_removed", "n_spans"],
        )


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, reach: int = REACH, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, kept binary, n_removed, n_spans): each text without what repeats.

    Texts are taken as UTF-8 bytes, a null text is empty; what remains need not be valid UTF-8.
    Every copy goes, the first as well. Rows stay as often as they are, also with a null id; an
    empty table gives no rows; other columns are not read. Rows are
    numbered in a written copy, which the later scans read.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text)
    kind = given.schema["id"].dataType.simpleString()
    with batches_of(docs.sparkSession, BATCH):
        rows = written(given.mapInArrow(_compressed, f"row long, id {kind}, n_bytes long, text binary"), "rows")
    begin = mark()
    with batches_of(docs.sparkSession, BATCH):
        spans = written(repeated_spans(rows.select("row", "text"), length, reach, hot), "spans")
    remove(docs.sparkSession, since(begin)[:-1])
    joined = rows.join(spans.hint("merge"), "row", "left").select("id", "n_bytes", "text", "spans")
    return joined.mapInArrow(_without, f"id {kind}, n_bytes long, kept binary, n_removed long, n_spans long")
