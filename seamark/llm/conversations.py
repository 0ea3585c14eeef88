"""Repair of damaged conversations: bidirectional Dijkstra over the lattice of edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import fresh, ready
from seamark.session import write_out

#: Rows, and bytes of text, of one conversation that are searched and kept together; a longer one is taken in parts.
ROWS, BYTES = 1024, 4 << 20
BLANK_SIGNS = "\t\n\x0b\x0c\r "
STOPS = ".!?"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What the roles so far end with: nothing, a system row, a user's or an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
CLASS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Who speaks next, and who may have spoken before.
NEXT = (USER, USER, ASSISTANT, USER)
BEFORE = ((), (START,), (START, SYSTEM, ASSISTANT), (USER,))
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
DONE = (START, ASSISTANT)
FAR = 1 << 60


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with five kinds of damage, by h, the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats it, 4
    makes it the user's. A null role, text, id or turn counts as one space, but stays null where
    it is an id or a turn. Dropped rows stay as rows with a null role, so that no conversation is lost.
    """
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    h = F.crc32(place.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(h == 0, F.lit(None)).when(h == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(h == 1, F.lit("")).when(h == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
        F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def search(codes: Sequence[tuple[int, int]], entry: int, exits: Sequence[int]) -> tuple[int, str] | None:
    """The least cost of repairing rows (class, fault) from state ``entry`` to one of ``exits``, and its least audit.

    Nodes are (rows taken, state). One heap goes forward from the entry, one back
    from the exits; the side whose next node is nearer goes on. Where they meet, the
    sum of both distances bounds the cost; the search ends when no sum of the next
    two can reach it, so that all meeting nodes of equal cost are known. From these the
    forward nodes of cheapest paths are marked backwards, and the least audit is read
    along the nodes that are marked or have the rest of the cost behind them.
    """
    count = len(codes)
    size = 4 * (count + 1)
    ahead, behind = [FAR] * size, [FAR] * size
    ahead[entry] = 0
    forward, reverse = [entry], []
    best, meeting = FAR, []
    for state in exits:
        behind[4 * count + state] = 0
        heappush(reverse, 4 * count + state)
        if 4 * count + state == entry:
            best, meeting = 0, [entry]

    def onward(node: int) -> list[tuple[str, int, int]]:
        """(label, next node, cost) in the order of the labels."""
        row, state = divmod(node, 4)
        speaker = NEXT[state]
        if row == count:
            return [("I", 4 * row + speaker, INSERT)]
        who, fault = codes[row]
        out = [("D", node + 4, DELETE), ("I", 4 * row + speaker, INSERT)]
        if fault not in (BLANK, DUPLICATE):
            extra = CUT if fault == TRUNCATED else 0
            if who == speaker or (who == SYSTEM and state == START):
                out.append(("K", 4 * row + 4 + who, KEEP + extra))
            out.append(("R", 4 * row + 4 + speaker, REROLE + extra))
        return out

    def backward(node: int) -> list[tuple[int, int]]:
        """(node before, cost)."""
        row, state = divmod(node, 4)
        before = BEFORE[state]
        out = [(4 * row + p, INSERT) for p in before] if state in ROLES else []
        if row:
            out.append((node - 4, DELETE))
            who, fault = codes[row - 1]
            if fault not in (BLANK, DUPLICATE):
                extra = CUT if fault == TRUNCATED else 0
                if who == state:
                    out += [(4 * row - 4 + p, KEEP + extra) for p in before]
                if state in ROLES:
                    out += [(4 * row - 4 + p, REROLE + extra) for p in before]
        return out

    while forward and reverse:
        near, far = forward[0] // size, reverse[0] // size
        if near + far > best:
            break
        if near <= far:
            node = heappop(forward) % size
            if near > ahead[node]:
                continue
            for _, other, cost in onward(node):
                total = near + cost
                if total < ahead[other]:
                    ahead[other] = total
                    heappush(forward, total * size + other)
                    if total + behind[other] < best:
                        best, meeting = total + behind[other], [other]
                    elif total + behind[other] == best:
                        meeting.append(other)
        else:
            node = heappop(reverse) % size
            if far > behind[node]:
                continue
            for other, cost in backward(node):
                total = far + cost
                if total < behind[other]:
                    behind[other] = total
                    heappush(reverse, total * size + other)
                    if total + ahead[other] < best:
                        best, meeting = total + ahead[other], [other]
                    elif total + ahead[other] == best:
                        meeting.append(other)
    if best >= FAR:
        return None
    marked = set(meeting)
    while meeting:
        node = meeting.pop()
        for other, cost in backward(node):
            if other not in marked and ahead[other] + cost == ahead[node]:
                marked.add(other)
                meeting.append(other)
    audit, node, rest = [], entry, best
    ends = {4 * count + state for state in exits}
    while rest or node not in ends:
        for label, other, cost in onward(node):
            left = rest - cost
            if left >= 0 and (behind[other] == left or (other in marked and ahead[other] == best - left)):
                audit.append(label)
                node, rest = other, left
                break
    return best, "".join(audit)


@dataclass
class Part:
    """Consecutive rows of one conversation."""

    number: int = 0
    codes: list[tuple[int, int]] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    size: int = 0
    turns: int = 0  # distinct ones
    low: int | None = None
    high: int | None = None

    def add(self, turn: int | None, role: str | None, text: str, fault: int) -> None:
        if role is None:
            return
        self.codes.append((CLASS.get(role[:1], -1), fault))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def counts(self) -> list[int]:
        """Blank, duplicate and truncated rows, and pairs of rows whose initials don't follow each other."""
        faults = [f for _, f in self.codes]
        initials = [r[:1] for r in self.roles]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        return [faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal]


def repaired(roles: Sequence[str], texts: Sequence[str], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that an audit leaves, from a state on."""
    rows = zip(roles, texts, strict=True)
    for label in audit:
        if label == "I":
            state = NEXT[state]
            yield ROLES[state], ""
            continue
        role, text = next(rows)
        if label == "K":
            state = CLASS[role[0]]
            yield role, text
        elif label == "R":
            state = NEXT[state]
            yield ROLES[state], text


class Digest:
    """SHA-256 of ``role:text`` lines, fed one after another."""

    def __init__(self) -> None:
        self.sha, self.first = hashlib.sha256(), True

    def feed(self, rows: Iterator[tuple[str, str]]) -> None:
        for role, text in rows:
            self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
            self.first = False


FINAL = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
FINAL_TYPES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROUTE = "struct<entry:int,exit:int,cost:long,audit:string>"
PART_TYPES = (
    f"part long, counts array<long>, turns long, low long, high long, roles array<string>, texts array<string>, routes array<{ROUTE}>"
)


def gaps(low: int | None, high: int | None, turns: int) -> int:
    """Turns that are missing between the first and the last, at most what a long can say."""
    return 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)


def whole(part: Part) -> list:
    """What is to be said of a conversation of one part."""
    cost, audit = search(part.codes, START, DONE)
    digest = Digest()
    digest.feed(repaired(part.roles, part.texts, audit, START))
    return [gaps(part.low, part.high, part.turns), *part.counts(), cost, audit, digest.sha.hexdigest()]


def routes(part: Part) -> list[dict]:
    """The cheapest way through a part from each state to each state that can be reached from it."""
    found = [(p, q, search(part.codes, p, [q])) for p in range(4) for q in range(4) if q > SYSTEM or p == q or p == START]
    return [{"entry": p, "exit": q, "cost": r[0], "audit": r[1]} for p, q, r in found if r]


def repair(rows: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``rows(conv_id, turn, role, text, copy)``: what is wrong with a conversation, and its cheapest repair.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost long, audit, repaired_sha256 string.
    Rows are taken by turn, nulls first, then role and text; a null role marks a row that is gone. The first fault
    of a row counts: blank, duplicate (role and text seen earlier in the conversation), truncated (doesn't end with a stop). A row can be
    kept (cost 0), given to the user or the assistant (1) or deleted (2; blank and duplicate rows must be), an empty
    row of either inserted (5); a truncated row that stays adds 5. The roles left are nothing, or
    a system row if any and then user and assistant in turn. Of the cheapest edits those of the least audit in ASCII order count.
    A role that begins with another letter, or is empty, is never kept as it is. Null ids are one conversation. A conversation without rows
    has zeros, an empty audit and the hash of nothing.

    Rows are sorted in ranges of (conv_id, turn, role, text), so no conversation, however long, is
    gathered in one task. One that lies within a range and is short is repaired at once. The others
    are cut into parts, whose cheapest ways from state to state are found
    where they lie, and put together by the same rule; there a task reads one part at a
    time. First rows of repeated texts are found by an aggregate over their hashes.
    """
    spark = ready(rows.sparkSession)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    stopped = F.right(F.rtrim(F.col("text"), F.lit(BLANK_SIGNS)), F.lit(1)).isin(*STOPS)
    told = rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(blank, BLANK).when(stopped, NONE).otherwise(TRUNCATED).alias("fault"),
        F.xxhash64("conv_id", F.sha2(F.concat("role", F.lit("\0"), "text").cast("binary"), 256)).alias("same"),
        F.struct(F.col("turn").isNotNull().alias("some"), "turn", "copy", F.monotonically_increasing_id().alias("id")).alias("place"),
    )
    # Only groups of equal rows of one conversation are looked up, by a 64-bit hash and the place of the first.
    live = told.where("role IS NOT NULL AND fault <> 1")
    repeated = live.groupBy("same").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first")
    is_repeat = F.col("first").isNotNull() & (F.col("first") != F.col("place")) & (F.col("fault") != BLANK) & F.col("role").isNotNull()
    faults = F.when(is_repeat, DUPLICATE).otherwise(F.col("fault")).cast("int")
    marked = told.join(repeated, "same", "left").select(
        "conv_id", "turn", "role", "text", faults.alias("fault"), F.col("place.copy").alias("copy"), F.col("place.id").alias("id")
    )
    order = ["conv_id", "turn", "role", "text", "copy", "id"]
    lines = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = dict(rows.dtypes)["conv_id"]
    names = ["conv_id", "open", *FINAL, "part", "counts", "turns", "low", "high", "roles", "texts", "routes"]
    schema = f"conv_id {kind}, open boolean, {FINAL_TYPES}, {PART_TYPES}"
    whole_types = spark.createDataFrame([], schema).schema
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in whole_types.fields[1:]])

    def walk(batches):
        first = TaskContext.get().partitionId() << 32
        out: list[list] = []
        keys: list[pa.Array] = []
        part, current, key, begun, split = Part(first), None, None, True, False

        def close(open_: bool) -> None:
            done = [None] * len(FINAL) if open_ else whole(part)
            rest = [part.number, part.counts(), part.turns, part.low, part.high, part.roles, part.texts, routes(part)] if open_ else [None] * 8
            out.append([open_, *done, *rest])
            keys.append(key)

        def flush():
            columns = [pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)]
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *columns], names)
            out.clear(), keys.clear()
            return batch

        for batch in batches:
            ids = batch.column(0).to_pylist()
            columns = [batch.column(k).to_pylist() for k in range(1, 5)]
            for i, (turn, role, text, fault) in enumerate(zip(*columns, strict=True)):
                if key is None or ids[i] != current:
                    if key is not None:
                        # The first conversation of a range may have begun in the one before.
                        close(begun or split)
                        begun = False
                    part, current, key, split = Part(part.number + 1), ids[i], batch.column(0).slice(i, 1), False
                elif len(part.codes) >= ROWS or part.size >= BYTES:
                    close(True)
                    part, split = Part(part.number + 1), True
                part.add(turn, role, text, fault)
                if len(out) >= 500 or sum(map(len, (r[-2] or () for r in out[-8:]))) > 4 * ROWS:
                    yield flush()
        if key is not None:
            close(True)  # the last one may go on in the next range
        if out:
            yield flush()

    found = write_out(lines.select(*order[:4], "fault").mapInArrow(walk, schema), "repairs")
    parts = found.where("open")
    keyed = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    at = fresh(rows, "at")
    return found.where("NOT open").select("conv_id", *FINAL).unionByName(_joined(keyed, kind, at))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _joined(parts: DataFrame, kind: str, at: str) -> DataFrame:
    """Conversations out of their parts, sorted by (conv_id, part).

    Going over the parts, the cheapest audit up to each of the four states is kept as
    a chain of parts, then the chain of the best end is followed and its texts are hashed. Both read one part at a time:
    the first pass the routes, the second the texts, so a task never holds a conversation's texts.
    """
    slim = parts.select("conv_id", "part", "counts", "turns", "low", "high", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"), "routes")
    edges = slim.select(
        "conv_id", "part", "counts", "turns", "low", "high", F.get("initials", F.lit(0)).alias("head"), F.try_element_at("initials", F.lit(-1)).alias("tail"), "routes"
    )
    choice = f"conv_id {kind}, {FINAL_TYPES.replace(', repaired_sha256 string', '')}, chosen array<struct<part:long,entry:int,audit:string>>"

    def groups(batches) -> Iterator[tuple[pa.Array, Iterator[dict]]]:
        """Runs of rows with one conv_id, read as they come."""
        rows = ((batch, i) for batch in batches for i in range(batch.num_rows))
        held = next(rows, None)
        while held is not None:
            key = held[0].column(0).slice(held[1], 1)
            same = key[0].as_py()

            def own():
                nonlocal held
                while held is not None and held[0].column(0)[held[1]].as_py() == same:
                    batch, i = held
                    yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names) if k}
                    held = next(rows, None)

            mine = own()
            yield key, mine
            for _ in mine:
                pass

    def choose(batches):
        for key, rows in groups(batches):
            counts, turns, low, high, tail = [0, 0, 0, 0], 0, None, None, None
            reach: dict[int, tuple[int, tuple | None]] = {START: (0, None)}
            for row in rows:
                counts = [a + b for a, b in zip(counts, row["counts"], strict=True)]
                if row["head"] is not None:
                    counts[3] += tail is not None and tail + row["head"] not in LEGAL
                    tail = row["tail"]
                if row["low"] is not None:
                    turns += row["turns"] - (high == row["low"])
                    low, high = row["low"] if low is None else low, row["high"]
                onward: dict[int, tuple[int, tuple | None]] = {}
                for r in row["routes"]:
                    if r["entry"] not in reach:
                        continue
                    cost, chain = reach[r["entry"]]
                    cost, link = cost + r["cost"], (chain, row["part"], r["entry"], r["audit"])
                    held = onward.get(r["exit"])
                    if held is None or cost < held[0] or (cost == held[0] and _less(link, held[1])):
                        onward[r["exit"]] = cost, link
                reach = onward
            ends = [reach[s] for s in DONE if s in reach]
            cost = min(e[0] for e in ends)
            best = None
            for e in ends:
                if e[0] == cost and (best is None or _less(e[1], best)):
                    best = e[1]
            chosen = [{"part": part, "entry": entry, "audit": audit} for part, entry, audit in _links(best)]
            values = [gaps(low, high, turns), *counts, cost, "".join(c["audit"] for c in chosen)]
            types = [pa.int64()] * 6 + [pa.string()]
            steps = pa.array([chosen], pa.list_(pa.struct([("part", pa.int64()), ("entry", pa.int32()), ("audit", pa.string())])))
            yield pa.RecordBatch.from_arrays(
                [key, *[pa.array([v], t) for v, t in zip(values, types, strict=True)], steps], ["conv_id", *FINAL[:-1], "chosen"]
            )

    chosen = write_out(edges.mapInArrow(choose, choice), "routes")
    steps = chosen.select(F.inline("chosen")).withColumnsRenamed({"part": at})
    # A part's number is its own, so it is enough to join by.
    texts = parts.select("conv_id", "part", "roles", "texts").join(steps, F.col("part") == F.col(at)).drop(at)

    def hashed(batches):
        for key, rows in groups(batches):
            digest = Digest()
            for row in rows:
                digest.feed(repaired(row["roles"], row["texts"], row["audit"], row["entry"]))
            yield pa.RecordBatch.from_arrays([key, pa.array([digest.sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    sorted_ = texts.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "part", "roles", "texts", "entry", "audit")
    hashes = sorted_.mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string")
    hashes = hashes.select(F.col("conv_id").alias(at), "repaired_sha256")
    return chosen.join(hashes, F.col("conv_id").eqNullSafe(F.col(at))).select("conv_id", *FINAL)


def _links(chain: tuple | None) -> list[tuple[int, int, str]]:
    out = []
    while chain is not None:
        chain, *link = chain
        out.append(tuple(link))
    return out[::-1]


def _less(a: tuple, b: tuple) -> bool:
    """Whether the audit of one chain is before another's; links that both share are not looked at."""
    own, other = [], []
    while a is not b and a is not None and b is not None and a[1] == b[1]:
        own.append(a[3]), other.append(b[3])
        a, b = a[0], b[0]
    return "".join(reversed(own)) < "".join(reversed(other))
