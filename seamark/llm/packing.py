"""Packing of documents into sequences of fixed length by a configuration linear program."""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamark.llm.common import frugal, ready
from seamark.session import write_out

END = 1
#: Bytes of words and ids, with what Python needs for each, that a worker remembers before it starts anew.
REMEMBERED = 24 << 20


class WordIds:
    """Ids of a BPE with word ends, word by word.

    The tokenizer drops white space and never joins across it, so a text's ids are
    those of its words one after another, and each distinct word is encoded once. The
    common words, of plain Latin letters with marks around them, are merged by
    the same merge table in a faster encoder; all others go through the tokenizer itself, as
    do words that hold the name of a special token. With ``ordinary`` such a name is text like any other.
    """

    PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[!-/:-@\[-`{-~]+")
    SIMPLE = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]|[!-&(-/:-@\[-`{-~])+")  # no digit and no apostrophe, which split further
    STRANGE = re.compile("[\x1c-\x1f]")  # white space to split(), but not to the tokenizer

    def __init__(self, path: str, ordinary: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        added = [] if ordinary else [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self._merges(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _merges(self, path: str) -> None:
        import tiktoken

        model = json.loads(Path(path).read_text())["model"]
        shown = byte_signs()
        mark = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            ends = token.endswith(mark)
            return bytes(shown[c] for c in (token[: -len(mark)] if ends else token)) + b"\xff" * ends

        # The end of a word is a byte that UTF-8 has no use for; it first joins the last byte, then merges go by rank.
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        made = set(merged)
        rest = sorted((i, t) for t, i in model["vocab"].items() if t not in made and t[:1] in shown)
        tokens = [t for _, t in rest if t.endswith(mark)] + merged + [t for _, t in rest if not t.endswith(mark)]
        ranks = {raw(t): k for k, t in enumerate(tokens) if len(raw(t)) > 1 or not t.endswith(mark)}
        for b in range(256):
            ranks.setdefault(bytes([b]), len(tokens) + b)
        self.ids = {k: model["vocab"][t] for k, t in enumerate(tokens)}
        self.fast = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.id_bytes = [self.ids.get(k, 0).to_bytes(4, "little") for k in range(len(tokens) + 256)]

    def word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            pieces = [word.lower()]
        elif self.SIMPLE.fullmatch(word) and not self.special.search(word.lower()):
            pieces = self.PLAIN.findall(word.lower())
        else:
            pieces = None
        if pieces is not None:
            encode, id_bytes = self.fast.encode_single_piece, self.id_bytes
            return b"".join([id_bytes[r] for p in pieces for r in encode(p.encode() + b"\xff")])
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit numbers."""
        if self.STRANGE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, known = text.split(), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if self.held > REMEMBERED:
                self.forget()
                known = self.known
            out = []
            for w in words:
                ids = known.get(w)
                if ids is None:
                    ids = self.word(w)
                    if len(w) <= 64:  # longer ones hardly come again
                        known[w] = ids
                        self.held += 200 + len(w) + len(ids)
                out.append(ids)
            return b"".join(out)


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary: itself, or the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


@lru_cache(maxsize=2)
def word_ids(path: str, ordinary: bool = False) -> WordIds:
    return WordIds(path, ordinary)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, ordinary: bool = False) -> DataFrame:
    """(doc_id, row, piece int, start long, length long, ids_crc32 long): each document's ids and the end id, cut only if longer than ``capacity``."""

    def cut(batches):
        encoder = word_ids(tokenizer, ordinary)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            places, piece, start, length, crc = [], [], [], [], []
            for row, body in enumerate(batch.column(2).to_pylist()):
                ids = encoder.text(body or "") + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    places.append(row), piece.append(k // (4 * capacity)), start.append(k // 4)
                    length.append(len(part) // 4), crc.append(zlib.crc32(part))
            at = pa.array(places, pa.int32())
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(piece, pa.int32()), *numbers],
                ["doc_id", "row", "piece", "start", "length", "ids_crc32"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string"))
    return rows.mapInArrow(frugal(cut), f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long")


def solve(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int, step: float, rate: float) -> dict[tuple[int, ...], float]:
    """How often each configuration is used: an approximate solution of the configuration program.

    The program: use as few configurations, sets of classes whose ``sizes`` fit
    ``capacity``, as cover ``need`` of each class. Multiplicative weights: a class has a
    price; the configuration of the highest price is found by the knapsack's dynamic
    program and used a little; classes covered further than others lose price. At the
    end all uses are scaled so that no class is covered more than once.
    """
    base = np.maximum(sizes, 0.5) / capacity
    price, cover = base.copy(), np.zeros(len(sizes))
    used: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        chosen = knapsack(sizes, price, capacity)
        places, often = np.unique(chosen, return_counts=True)
        amount = step * float((need[places] / often).min())
        config = tuple(map(int, np.sort(chosen)[::-1]))
        used[config] = used.get(config, 0.0) + amount
        cover[places] += amount * often / need[places]
        price = base * np.exp(-rate * (cover - cover.min()))
    return {config: x / cover.max() for config, x in used.items()}


def knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """Places of the classes, with repetitions, that fit ``capacity`` at the highest price. ``sizes`` ascend from 1."""
    value, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes[0]), capacity + 1):
        fits = int(np.searchsorted(sizes, room, "right"))
        total = price[:fits] + value[room - sizes[:fits]]
        k = int(total.argmax())
        value[room], taken[room] = max((value[room - 1], -1), (total[k], k))
    out, room = [], capacity
    while room >= sizes[0]:
        if taken[room] < 0:
            room -= 1
        else:
            out.append(taken[room])
            room -= int(sizes[taken[room]])
    return np.array(out, np.int64)


def plan(
    counts: np.ndarray, capacity: int, classes: int = 128, rounds: int = 1500, step: float = 0.1, rate: float = 4.0
) -> list[tuple[int, int, int, int, int]]:
    """(length, first, count, sequence, offset): pieces ``first`` .. of a length go to sequences ``sequence`` .., at ``offset``.

    Full pieces stand alone. The others fall into ``classes`` of near lengths, for which
    the program is solved; its uses are rounded down. A use takes real lengths: the
    commonest of each class, and as its last piece the one that fits best. What is left over
    is packed by best fit, the longest pieces first. Both place many equal
    sequences at once, so the plan's size depends on the lengths and rounds, not on the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    out, taken, sequence = [], np.zeros(len(counts), np.int64), 0
    width = -(-capacity // classes)

    def place(config: list[int], most: int) -> int:
        nonlocal sequence
        lengths, often = np.unique(config, return_counts=True)
        times = min(most, int((left[lengths] // often).min()))
        offset = 0
        for length in config:
            out.append((length, int(taken[length]), times, sequence, offset))
            taken[length] += times
            left[length] -= times
            offset += length
        sequence += times
        return times

    def best_fit(room: int, spent: list[int], least: int = 1) -> int:
        """The longest length left that fits, if it is ``least`` or more; else 0."""
        have = np.flatnonzero(left[least : room + 1])[::-1]
        return next((int(n) + least for n in have if left[n + least] > spent.count(n + least)), 0)

    if left[capacity]:
        place([capacity], int(left[capacity]))
    of = np.minimum((np.arange(capacity + 1) - 1) // width, classes - 1)
    need = np.bincount(of[1:], left[1:], minlength=classes)
    live = np.flatnonzero(need)
    if len(live):
        mean = np.bincount(of[1:], left[1:] * np.arange(1, capacity + 1), minlength=classes)[live] / need[live]
        units = np.maximum(1, np.round(mean / width)).astype(np.int64)
        uses = solve(units, need[live], capacity // width, rounds, step, rate)
        for config, x in sorted(uses.items(), key=lambda c: (-units[list(c[0])].sum(), c[0])):
            todo = int(x + 1e-9)
            while todo:
                lengths: list[int] = []
                for k in config[:-1]:
                    lo = int(live[k]) * width + 1
                    hi = min(lo + width, capacity + 1 - sum(lengths))
                    rest = left[lo:hi] - np.bincount(np.array(lengths, np.int64), minlength=capacity + 1)[lo:hi]
                    if hi > lo and rest.max() > 0:
                        lengths.append(lo + int(rest.argmax()))
                last = best_fit(capacity - sum(lengths), lengths)
                lengths += [last] * bool(last)
                if not lengths:
                    break
                todo -= place(lengths, todo)
    while left.any():
        lengths = []
        while last := best_fit(capacity - sum(lengths), lengths):
            lengths.append(last)
        place(lengths, int(left.max()))
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, ordinary: bool = False) -> DataFrame:
    """One row per piece: (doc_id, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long).

    Documents are encoded once, each with an end id; a null text counts as empty and
    is the end id alone. The pieces' lengths are counted; the counts, at most
    ``capacity`` numbers for any corpus, give the plan on the driver. Pieces of a length
    are numbered by running counts over parts of it, about as many as each part has pieces (the root of the length's count), so
    no length is gathered in one task, and find their place in the plan by length and number. The plan has at
    most a few entries per length and round, whatever the size of the corpus.
    Names of special tokens in a text are those tokens, as the tokenizer has it; with ``ordinary`` they are text like any other.
    Null or repeated ids are packed like others; an empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    pieces = write_out(pieces_of(docs, tokenizer, capacity, ordinary), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["length"]] = row["n"]
    # At most ``capacity`` entries.
    many = [(int(k), int(np.ceil(np.sqrt(counts[k])))) for k in np.flatnonzero(counts > 1)]
    parts_of = F.lit(1)
    if many:
        listed = F.map_from_arrays(F.array(*[F.lit(k).cast("long") for k, _ in many]), F.array(*[F.lit(n) for _, n in many]))
        parts_of = F.coalesce(F.try_element_at(listed, F.col("length")), F.lit(1))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), parts_of).cast("int"))
    parts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    columns = list(zip(*plan(counts, capacity), strict=True)) or [()] * 5
    names = ["length", "first", "count", "sequence", "offset"]
    # As an Arrow table it is local to the driver; rows would start Python workers to read them.
    places = spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)}))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    starts = parts.select("length", "salt", before.alias("before"))
    numbered = (
        pieces.withColumn("number", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece")) - 1)
        .join(starts, ["length", "salt"])
        .withColumn("number", F.col("number") + F.col("before"))
    )
    number, first = F.col("number"), F.col("first")
    # The plan's size has a bound that doesn't depend on the corpus.
    found = numbered.join(
        F.broadcast(places), (numbered["length"] == places["length"]) & (number >= first) & (number < first + F.col("count"))
    )
    return found.select(
        "doc_id", "piece", "start", numbered["length"], "ids_crc32", (F.col("sequence") + number - first).alias("sequence_id"), "offset"
    )
