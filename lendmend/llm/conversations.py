"""Conversation structure repair by an auction for shortest paths.

A conversation's turns and the roles that may come next span a lattice: from the place before a turn,
edits lead to the place after it (keep, change the role, delete) or stay before it (insert), each at
a whole cost. The cheapest repair is a shortest path through it, found by an auction: node prices
never exceed the cost of any arc plus the price behind it; a path grows along an arc that meets its
node's price, and otherwise raises that price to the least there is and steps back. Where the path
arrives, its prices are the costs to the end, and the arcs that meet them, taken in the order of
their letters, give the audit.

A conversation may hold any share of the rows. Turns are sorted over the whole table and cut into
blocks; a block of a conversation with several yields its costs from each state to each state, these
small tables are chained from the end of the conversation to its start and back, and then each block
is traced by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendmend.llm.common import written

KEEP, RECAST, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # cost of each edit, and of leaving a truncated turn
BLOCK = 4096  # turns of a block
BLOCK_BYTES = 4 << 20  # text of a block, about
STRETCH = 32  # turns that one auction covers

#: What may come next: the start; after the system turn; after a user turn; after a whole pair.
START, SYSTEM, USER, PAIR = range(4)
STATES = range(4)
NEXT = (USER, USER, PAIR, USER)  # the state after the one role that an inserted or changed turn can have
NEXT_ROLE = ("user", "user", "assistant", "user")
OPENING = "s"
INITIAL = ("u", "u", "a", "u")
FINE, CUT_OFF, GONE = range(3)  # what a turn's fault asks for
FAR = 1 << 50  # no way
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): test damage by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes the characters ``.!?``, 3 repeats the row, 4 makes
    it the user's. A null role or text is one space, and so is a null conv_id or turn where the
    checksum is taken.
    """

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20
    given = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("__kind"))
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("__kind") == 4, "user").otherwise(F.col("role"))
    out = given.where("__kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("__copies"))
    return out.select("*", F.explode("__copies")).select("conv_id", "turn", "role", "text")


class Lattice:
    """A stretch of turns with the prices of its places (turn, state).

    ``turns`` are (role initial, demand of the fault); ``ends`` the cost to the end from each state
    after the last turn.
    """

    def __init__(self, turns: list[tuple[str, int]], ends: list[int]):
        self.turns, self.ends = turns, ends
        # What every way must pay for the turns still ahead: a price below all costs.
        floor = [min(ends)]
        for _, demand in reversed(turns):
            floor.append(floor[-1] + (0, CUT, DELETE)[demand])
        self.price = [[p] * 4 for p in reversed(floor)]
        # States from which no end is reached.
        dead = [USER, PAIR] if min(ends[USER], ends[PAIR]) >= FAR else []
        if dead and ends[SYSTEM] >= FAR:
            dead.append(SYSTEM)
        for row in self.price:
            for q in dead:
                row[q] = FAR

    def arcs(self, i: int, state: int) -> list[tuple[str, int, int, int]]:
        """(letter, cost, turn, state) of the edits at a place, in the order of their letters."""
        initial, demand = self.turns[i]
        out = [("D", DELETE, i + 1, state), ("I", INSERT, i, NEXT[state])]
        if demand != GONE:
            extra = CUT if demand == CUT_OFF else 0
            if state == START and initial == OPENING:
                out.append(("K", KEEP + extra, i + 1, SYSTEM))
            if initial == INITIAL[state]:
                out.append(("K", KEEP + extra, i + 1, NEXT[state]))
            else:
                out.append(("R", RECAST + extra, i + 1, NEXT[state]))
        return out

    def cost(self, state: int) -> int:
        """The auction: a path from the first turn to the end; returns its cost, the origin's price."""
        price, n = self.price, len(self.turns)
        path = [(0, state)]
        while True:
            i, q = path[-1]
            if i == n:  # the only way on is the end
                if price[i][q] >= self.ends[q]:
                    return price[0][state]
                price[i][q] = self.ends[q]
                path.pop()
                if not path:
                    return price[0][state]
                continue
            best, to = FAR * 2, None
            for _, cost, j, r in self.arcs(i, q):
                if (c := cost + price[j][r]) < best:
                    best, to = c, (j, r)
            if price[i][q] < best:
                price[i][q] = best  # contract: step back, or try again at the origin
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)  # extend

    def trace(self, state: int) -> tuple[str, int]:
        """Letters of the cheapest way, the least in ASCII order, and the state where it ends."""
        i, q, letters = 0, state, []
        while i < len(self.turns):
            own = self.price[i][q]
            letter, _, i, q = next(a for a in self.arcs(i, q) if a[1] + self.price[a[2]][a[3]] == own)
            letters.append(letter)
        return "".join(letters), q


def solved(turns: list[tuple[str, int]], ends: list[int], entries: list[int]) -> list[tuple[Lattice, ...]]:
    """Stretches of a block, first to last, whose auctions have run from the states before them.

    The last one is done first: its origins' prices are the ends of the one before it.
    """
    out: list[Lattice] = []
    for at in reversed(range(0, len(turns), STRETCH)):
        part = turns[at : at + STRETCH]
        lattice = Lattice(part, ends)
        asked = list(STATES) if at else entries
        ends = [FAR] * 4
        for q in asked:
            # A state from which no end is reached has no price to converge to.
            if _arrives(part, q, lattice.ends):
                ends[q] = lattice.cost(q)
        out.append(lattice)
    return out[::-1]


def _after(turns: list[tuple[str, int]], state: int) -> set[int]:
    """States in which a path from ``state`` can leave a stretch."""
    found = {USER, PAIR}
    if state in (START, SYSTEM):
        found.add(state)
    if state == START and any(x == OPENING and demand != GONE for x, demand in turns):
        found.add(SYSTEM)
    return found


def _arrives(turns: list[tuple[str, int]], state: int, ends: list[int]) -> bool:
    return any(ends[q] < FAR for q in _after(turns, state))


def costs(turns: list[tuple[str, int]]) -> list[int]:
    """Least cost from each state before a block to each state after it, row by row."""
    out = [[FAR] * 4 for _ in STATES]
    for end in STATES:
        ends = [0 if q == end else FAR for q in STATES]
        first = solved(turns, ends, list(STATES))[0]
        for q in STATES:
            if end in _after(turns, q):
                out[q][end] = first.price[0][q]
    return [c for row in out for c in row]


#: After the last turn nothing follows the start or a whole pair; else a pair or an answer is inserted.
LAST = [0, 2 * INSERT, INSERT, 0]


def ways(turns: list[tuple[str, int]], ends: list[int], entries: list[int]) -> dict[int, tuple[str, int]]:
    """For each state before a block, the edits through it and the state after it."""
    stretches = solved(turns, ends, entries)
    out = {}
    for entry in entries:
        letters, q = [], entry
        for lattice in stretches:
            part, q = lattice.trace(q)
            letters.append(part)
        out[entry] = "".join(letters), q
    return out


def _turns(codes: bytes) -> list[tuple[str, int]]:
    """Turns from their codes, a byte each: role initial (other than s, u, a: x) and demand."""
    return [("xsua"[c >> 2], c & 3) for c in codes]


def _read(column: pa.Array) -> Iterator[list[tuple[str, int]]]:
    return (_turns(x.as_py()) for x in column)


def _chain_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost to the end after each block, over blocks sorted from the last one of a conversation to its first."""
    group, ends = None, LAST
    for batch in batches:
        out = []
        for key, table in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != group:
                group, ends = key, LAST
            out.append(ends)
            ends = [min(FAR, *(table[4 * q + r] + ends[r] for r in STATES)) for q in STATES]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int64()))], ["grp", "block", "ends"])


def _chain_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State before each block, over blocks sorted from the first one of a conversation to its last."""
    group, state = None, START
    for batch in batches:
        out = []
        for key, after in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != group:
                group, state = key, START
            out.append(state)
            state = after[state]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.int32())], ["grp", "block", "state"])


def _cut(most: int):
    """Adds the block, numbered within the partition, to sorted rows: a new one for each conversation, and where one is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place, size, last = -1, 0, 0, None
        for batch in batches:
            blocks, places = [], []
            for key, n in zip(batch.column("grp").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if key != last or place >= most or size >= BLOCK_BYTES:
                    block, place, size, last = block + 1, 0, 0, key
                blocks.append(block)
                places.append(place)
                place, size = place + 1, size + n
            columns = [pa.array(blocks, pa.int64()), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns], ["block", "place", *batch.schema.names])

    return run


def _with_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = [costs(turns) for turns in _read(batch.column(2))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(tables, pa.list_(pa.int64()))], ["grp", "block", "costs"])


def _with_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, block, codes, audits, after): edits and state after a block for each state before it (null where there is no way)."""
    for batch in batches:
        audits, after = [], []
        for turns, ends in zip(_read(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            entries = [START] if ends is None else list(STATES)
            found = ways(turns, ends or LAST, [q for q in entries if _arrives(turns, q, ends or LAST)])
            audits.append([found[q][0] if q in found else None for q in STATES])
            after.append([found[q][1] if q in found else None for q in STATES])
        columns = [pa.array(audits, pa.list_(pa.string())), pa.array(after, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["grp", "block", "codes", "audits", "after"])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, block, place, steps): each turn's edits with the roles they give, null where it is the turn's own or none.

    Inserts go with the turn after them, those after the last turn of a conversation with it.
    """
    names = ["grp", "block", "place", "steps"]
    kind = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string())]))
    for batch in batches:
        grp, block, codes, state, audits, is_last = (c.to_pylist() for c in batch.columns)
        for k in range(len(grp)):
            turns, q, steps, open_ = _turns(codes[k]), state[k] or START, [], []
            for letter in audits[k][q]:
                initial = turns[len(steps)][0]
                if letter in "IR":
                    open_.append({"edit": letter, "role": NEXT_ROLE[q]})
                else:
                    open_.append({"edit": letter, "role": None})
                if letter != "D":
                    q = SYSTEM if letter == "K" and q == START and initial == OPENING else NEXT[q]
                if letter != "I":
                    steps.append(open_)
                    open_ = []
            while is_last[k] and LAST[q]:
                steps[-1].append({"edit": "I", "role": NEXT_ROLE[q]})
                q = NEXT[q]
            n = len(steps)
            yield pa.RecordBatch.from_arrays(
                [pa.array([grp[k]] * n), pa.array([block[k]] * n), pa.array(range(n), pa.int32()), pa.array(steps, kind)], names
            )


def with_faults(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with a row number, the conversation ``grp`` and each row's first fault.

    Blank (1): no character but white space. Duplicate (2): role and text stand in an earlier row of
    the conversation. Truncated (3): the last character that is no white space is none of ``.!?``.
    """
    grp = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    own = turns.select(grp.alias("grp"), "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("row"))
    rows = written(own, "turns", compression="zstd")
    same = F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text"), 256).alias("same")
    keyed = rows.select("*", same)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    first = keyed.groupBy("grp", "same").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    often = first.where("n > 1").select("grp", "same", F.col("first.row").alias("first_row"))
    body = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = (
        F.when(body == "", BLANK)
        .when(F.col("row") != F.col("first_row"), DUPLICATE)
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED)
    )
    return keyed.join(often, ["grp", "same"], "left").select(*rows.columns, fault.alias("fault"))


def repair_conversations(turns: DataFrame, block_turns: int = BLOCK) -> DataFrame:
    """Cheapest repair of conversations (conv_id, turn, role, text), one row for each edit.

    (grp, conv_id, turn, was, fault, block, place, step, edit, role, text, cost): ``grp`` is the
    conversation, block, place and step the order in it, ``was`` the initial of a row's role and
    ``fault`` 1 blank, 2 duplicate, 3 truncated or null. Edit K keeps a turn, R gives it the next
    role, D deletes it (role and text are null then; blank and duplicate turns must go), I inserts an
    empty turn (turn, was and fault are null). The kept roles read: a system turn or none, then pairs
    of a user and an assistant turn; or nothing at all. Of the cheapest repairs the one whose edits
    come first in ASCII order is given.

    Rows of a conversation are taken by turn, nulls first; rows of the same turn by role, hash of the
    text and place in the table. A null conv_id is a conversation of its own, a null role or text
    counts as one space, and a role that starts with none of s, u, a fits nowhere. Repeated rows are
    duplicates. An empty table gives no rows; other columns are not read. A task holds the codes of a
    block, ``block_turns`` turns or about four megabytes of text, never a whole conversation.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = with_faults(turns.select("conv_id", "turn", *text))
    demand = F.when(F.col("fault").isin(BLANK, DUPLICATE), GONE).when(F.col("fault") == TRUNCATED, CUT_OFF).otherwise(FINE)
    initial = F.substring("role", 1, 1)
    code = 4 * F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0) + demand
    sized = rows.select("*", code.alias("code"), F.octet_length("text").cast("long").alias("bytes"))
    order = ["grp", F.col("turn").asc_nulls_first(), "role", F.xxhash64("text"), "row"]
    ranged = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = ranged.mapInArrow(_cut(block_turns), "block long, place int, " + ", ".join(f"`{c}` {t}" for c, t in sized.dtypes))
    block = (F.spark_partition_id().cast("long") * (1 << 36) + F.col("block")).alias("block")
    cut = written(cut.select("grp", block, "place", "conv_id", "turn", "role", "text", "fault", "code"), "blocks", compression="zstd")

    codes = F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: F.char(x.code))
    codes = F.encode(F.array_join(codes, ""), "ISO-8859-1").alias("codes")
    blocks = written(cut.groupBy("grp", "block").agg(codes), "turn-codes")
    last = blocks.groupBy("grp").agg(F.max("block").alias("block"), (F.count("*") > 1).alias("several"))
    many = last.where("several").select("grp")
    tables = blocks.join(many, "grp", "left_semi").mapInArrow(_with_costs, "grp string, block long, costs array<long>")
    tables = tables.repartition("grp").sortWithinPartitions("grp", F.col("block").desc())
    ends = tables.mapInArrow(_chain_ends, "grp string, block long, ends array<long>")
    asked = blocks.join(ends, ["grp", "block"], "left").select("grp", "block", "codes", "ends")
    traced = asked.mapInArrow(_with_ways, "grp string, block long, codes binary, audits array<string>, after array<int>")
    traced = written(traced, "audits", compression="zstd")
    chain = traced.join(many, "grp", "left_semi").select("grp", "block", "after").repartition("grp").sortWithinPartitions("grp", "block")
    states = chain.mapInArrow(_chain_states, "grp string, block long, state int")
    chosen = traced.join(states, ["grp", "block"], "left").join(last.select("grp", "block", F.lit(True).alias("last")), ["grp", "block"], "left")
    chosen = chosen.select("grp", "block", "codes", "state", "audits", F.coalesce("last", F.lit(False)).alias("last"))
    steps = chosen.mapInArrow(_steps, "grp string, block long, place int, steps array<struct<edit: string, role: string>>")

    own = cut.withColumnRenamed("role", "own_role").withColumnRenamed("text", "own_text")
    edits = own.join(steps, ["grp", "block", "place"]).select("*", F.posexplode("steps").alias("step", "do"))
    new, gone = F.col("do.edit") == "I", F.col("do.edit") == "D"
    kept = F.when(~new & ~gone, F.when(F.col("fault") == TRUNCATED, CUT).otherwise(0)).otherwise(0)
    price = F.when(new, INSERT).when(gone, DELETE).when(F.col("do.edit") == "R", RECAST).otherwise(KEEP)
    return edits.select(
        "grp", "conv_id", F.when(~new, F.col("turn")).alias("turn"), F.when(~new, F.substring("own_role", 1, 1)).alias("was"),
        F.when(~new, F.col("fault")).alias("fault"), "block", "place", "step", F.col("do.edit").alias("edit"),
        F.when(~gone, F.coalesce("do.role", "own_role")).alias("role"),
        F.when(new, "").when(~gone, F.col("own_text")).alias("text"), (price + kept).cast("long").alias("cost"),
    )


class _Report:
    """What is told of one conversation, gathered edit by edit; its text is only hashed."""

    def __init__(self, row):
        self.grp, self.conv_id = row["grp"], row["conv_id"]
        self.turns = [None, None, 0]
        self.faults, self.illegal, self.cost, self.before = [0, 0, 0, 0], 0, 0, None
        self.audit, self.text, self.first = bytearray(), hashlib.sha256(), True

    def add(self, row):
        if row["edit"] != "I":
            if row["turn"] is not None and row["turn"] != self.turns[1]:
                self.turns = [row["turn"] if self.turns[0] is None else self.turns[0], row["turn"], self.turns[2] + 1]
            self.faults[row["fault"] or 0] += 1
            self.illegal += self.before is not None and self.before + row["was"] not in ("su", "ua", "au")
            self.before = row["was"]
        self.cost += row["cost"]
        self.audit += row["edit"].encode()
        if row["edit"] != "D":
            self.text.update(f"{'' if self.first else chr(10)}{row['role']}:{row['text']}".encode())
            self.first = False

    def row(self):
        low, high, n = self.turns
        gaps = high - low + 1 - n if n else 0
        return (self.grp, gaps, *self.faults[1:], self.illegal, self.cost, self.audit.decode(), self.text.hexdigest())


REPORT = "grp string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in REPORT.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in REPORT.split(", ")]
    open_ = None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if open_ is None or open_.grp != row["grp"]:
                if open_ is not None:
                    done.append(open_.row())
                open_ = _Report(row)
            open_.add(row)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(open_.row(), kinds, strict=True)], names)


def reports(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: its faults before the repair, and digests of the repair.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). A
    conversation's edits pass by in order through one task, which holds the audit and a hash state,
    not its texts. A conversation without edits has zeros, an empty audit and the hash of nothing.
    """
    needed = edits.select("grp", "conv_id", "turn", "was", "fault", "block", "place", "step", "edit", "role", "text", "cost")
    sorted_ = needed.repartition("grp").sortWithinPartitions("grp", "block", "place", "step")
    told = sorted_.mapInArrow(_report, REPORT)
    grp = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    every = conversations.select("conv_id").distinct().select("conv_id", grp.alias("grp")).join(told, "grp", "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
