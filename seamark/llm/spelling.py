"""Groups of spelling variants: words one edit apart, found by pivotal bigrams."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import ready
from seamark.session import write_out

#: Characters of a text that are looked at together; entries, and characters read, before a task hands its counts on.
SLICE, ENTRIES, READ = 1 << 20, 200_000, 1 << 26
#: Bigrams of a word that others may find it by, at least; three would do, more leave a choice.
PREFIX = 5
#: Counters for bigrams and for keys: they only set an order and a preference, so their coarseness never costs a pair.
GRAM_CELLS, KEY_CELLS = 1 << 16, 1 << 20
#: Stands on both sides of a word, so that words of any length have two disjoint bigrams.
EDGE = "\0\0"
#: Modulus and base of the hashes of a word's beginnings and ends; words that meet by a hash are compared in full.
PRIME, BASE = (1 << 61) - 1, 0x9E3779B97F4A7C15 % ((1 << 61) - 1)
#: Bytes of words in one batch of postings.
BATCH = 8 << 20

#: Latin letters in one byte each, A-Z in lower case; all else is a space.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256)
)


def letter_runs(text: str) -> Iterator[list[bytes]]:
    """The maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of a text, A-Z in lower case, in Latin-1; long texts in several lists."""
    rest = b""
    for k in range(0, len(text), SLICE):
        part = rest + text[k : k + SLICE].encode("latin-1", "replace").translate(LETTERS)
        if k + SLICE < len(text):
            cut = part.rfind(b" ") + 1
            part, rest = part[:cut], part[cut:]
        yield part.split()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, slips: int | None = None) -> DataFrame:
    """(word, n long): how often each letter run of at least ``least`` code points occurs in all whole texts.

    With ``slips``, runs lose a letter now and then: h is the CRC-32 of ``<key>:<run>``; where ``slips``
    divides it, the code point h modulo the length is deleted. Null texts have no words; a null key
    counts as an empty one. Every task adds up its own words before anything moves.
    """
    ready(docs.sparkSession)

    def count(batches):
        seen: Counter[bytes] = Counter()
        read = 0
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for runs in letter_runs(body or ""):
                    own = Counter([r for r in runs if len(r) >= least])
                    if not slips:
                        seen.update(own)
                        continue
                    for run, times in own.items():
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                        if h % slips == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least:
                                continue
                        seen[run] += times
                read += len(body or "")
                if len(seen) > ENTRIES or read > READ:
                    yield flush(seen)
                    seen.clear()
                    read = 0
        if seen:
            yield flush(seen)

    def flush(seen):
        words = pa.array([w.decode("latin-1") for w in seen], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(key).cast("string"), F.col(text).cast("string"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Grams:
    """The order of bigrams, the rarest first, and the bigrams a word is found by."""

    def __init__(self, counts: np.ndarray) -> None:
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        self.rank = rank.tolist()
        self.known: dict[str, int] = {}

    def order(self, gram: str) -> int:
        """A number for each bigram, growing with how common its cell is; no two bigrams have the same."""
        found = self.known.get(gram)
        if found is None:
            if len(self.known) > GRAM_CELLS:
                self.known.clear()
            cell = zlib.crc32(gram.encode()) % GRAM_CELLS
            found = self.known[gram] = self.rank[cell] << 42 | ord(gram[0]) << 21 | ord(gram[1])
        return found

    def prefix(self, padded: str) -> tuple[list[int], int]:
        """(places of the rarest bigrams, the order of the last), the same bigrams all or none.

        At least ``PREFIX``; but a bigram that the word holds very often is left out if the
        rarer ones have two disjoint places already, so a run of one letter isn't found by each of its places.
        """
        orders = [self.order(padded[k : k + 2]) for k in range(len(padded) - 1)]
        ranked = sorted(orders)
        last, low, high = ranked[0], len(padded), -1
        for k, order in enumerate(ranked):
            if order == last and k:
                continue
            if k >= PREFIX or (low + 2 <= high and bisect_right(ranked, order) > 4 * PREFIX):
                break
            last = order
            if high < low + 2:
                own = [i for i, o in enumerate(orders) if o == order]
                low, high = min(low, own[0]), max(high, own[-1])
        return [i for i, o in enumerate(orders) if o <= last], last


def keys_of(padded: str, places: list[int], sizes: Iterable[int]) -> list[list[tuple[int, int]]]:
    """For each size, and each place, two keys: of the bigram there with all that is left of it, and with all that is right of it."""
    left, right, code = {}, {}, 0
    ends = {p + 1 for p in places}
    for k, c in enumerate(padded):
        code = (code * BASE + ord(c) + 1) % PRIME
        if k in ends:
            left[k - 1] = code
    code, starts = 0, set(places)
    for k in range(len(padded) - 1, -1, -1):
        code = (code * BASE + ord(padded[k]) + 1) % PRIME
        if k in starts:
            right[k] = code
    return [[((left[p] * BASE + 2 * size) % PRIME, (right[p] * BASE + 2 * size + 1) % PRIME) for p in places] for size in sizes]


def pivots(places: list[int], left: list[int], right: list[int]) -> tuple[int, int]:
    """Indexes of two disjoint bigrams with the least sum of ``left`` of the first and ``right`` of the second.

    Dynamic programming from left to right: the best first one so far that ends before a place. ``places`` ascend.
    """
    best, first, cost, found = -1, 0, None, (0, 0)
    for k, place in enumerate(places):
        while first < k and places[first] + 2 <= place:
            if best < 0 or left[first] < left[best]:
                best = first
            first += 1
        if best >= 0 and (cost is None or left[best] + right[k] < cost):
            cost, found = left[best] + right[k], (best, k)
    return found


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): every pair of distinct words of ``words(word, n)`` that differ by one code point, once.

    The pivotal prefix filter for one edit. Bigrams are ordered by how rare they are;
    a word's prefix is its rarest ones, its pivots are two disjoint ones of these. One edit
    spares a pivot, and if the prefix of the other word reaches as far or farther in the
    order, the spared pivot is in that prefix. The position limit is taken as far as it
    goes: the edit is right of the first pivot, then all up to that pivot is the
    same in both words, or left of the second, then all from there on is. So words meet in
    keys of a bigram with its whole left or right side and a length, pivots against
    prefixes, and dynamic programming chooses the pivots whose keys the fewest words share. The join tests
    the pair at once, so what is no pair is never a row.
    """
    spark = ready(words.sparkSession)
    source = words.select("word", F.col("n").cast("long")).where("word IS NOT NULL")

    def common(batches):
        for batch in batches:
            seen: Counter[str] = Counter()
            for word in batch.column(0).to_pylist():
                text = EDGE + word + EDGE
                seen.update(map("".join, zip(text, text[1:])))
            cells = np.array([zlib.crc32(g.encode()) % GRAM_CELLS for g in seen], np.int64)
            yield summed(np.bincount(cells, list(seen.values()), minlength=GRAM_CELLS).astype(np.int64))

    def summed(cells: np.ndarray) -> pa.RecordBatch:
        used = np.flatnonzero(cells)
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array(cells[used])], ["cell", "n"])

    def totals(job, size: int) -> np.ndarray:
        """The sums of all tasks' counters, ``size`` numbers at most."""
        sums = source.select("word").mapInArrow(job, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size, np.int64)
        out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
        return out

    order = spark.sparkContext.broadcast(totals(common, GRAM_CELLS))

    def found_by(batches):
        grams = Grams(order.value)
        for batch in batches:
            keys = np.zeros(KEY_CELLS, np.int64)
            for word in batch.column(0).to_pylist():
                text = EDGE + word + EDGE
                for key in chain.from_iterable(keys_of(text, grams.prefix(text)[0], [len(word)])[0]):
                    keys[key % KEY_CELLS] += 1
            yield summed(keys)

    shares = totals(found_by, KEY_CELLS)
    shared = spark.sparkContext.broadcast(np.minimum(shares, (1 << 31) - 1).astype(np.int32))

    def post(batches):
        grams, share = Grams(order.value), shared.value
        out: list[tuple] = []
        size = 0

        def flush():
            nonlocal size
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, length = EDGE + word + EDGE, len(word)
                at, last = grams.prefix(text)
                less, own, more = keys_of(text, at, [length - 1, length, length + 1])
                one, two = pivots(at, [int(share[k[0] % KEY_CELLS]) for k in own], [int(share[k[1] % KEY_CELLS]) for k in own])
                head = text[: at[one] + 2]
                for keys in (less, own, more):
                    out += [(word, n, keys[one][0], last, 0, head, True), (word, n, keys[two][1], last, 1, head, True)]
                for pair in own:
                    out += [(word, n, pair[0], last, 0, None, False), (word, n, pair[1], last, 1, None, False)]
                    size += 2 * length
                    if size > BATCH:
                        yield flush()
                size += 12 * length
                if size > BATCH or len(out) > 20_000:
                    yield flush()
        if out:
            yield flush()

    names = ["word", "n", "key", "last", "side", "head", "asks"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
    schema = "word string, n long, key long, last long, side int, head string, asks boolean"
    posted = write_out(source.mapInArrow(post, schema), "postings")
    asking = posted.where("asks").select("key", "side", "head", "last", F.col("word").alias("a"), F.col("n").alias("n_a"))
    found = posted.where("NOT asks").select("key", F.col("side").alias("of"), F.col("last").alias("end"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    starts_alike = F.startswith(F.concat(F.lit(EDGE), F.col("b"), F.lit(EDGE)), F.col("head"))
    met = (
        (asking["key"] == found["key"])
        & (F.col("side") == F.col("of"))
        # One direction only, and the right pivot only where the left one doesn't find the pair.
        & ((F.col("last") < F.col("end")) | ((F.col("last") == F.col("end")) & (F.col("a") < F.col("b"))))
        & ((F.col("side") == 0) == starts_alike)
        & (F.col("a") != F.col("b"))
        & (F.levenshtein("a", "b", 1) == 1)
    )
    return asking.join(found, met).select("a", "b", "n_a", "n_b")


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root string; n, n_near, form_n long) for each word of ``words(word, n)``, whose words are distinct.

    Words are near if they differ by one inserted, deleted or replaced code point.
    ``form`` is the near word of the largest ``n`` (of equals the smallest in code-point order) if
    that is at least ``ratio`` times the word's own ``n``, else null, as is ``form_n``; ``root`` is where forms lead in the end,
    the word itself without one. ``ratio`` is above 1, so forms grow and never lead in
    a circle. A null word is left out; an empty table gives no rows. Near words of a word are counted
    and compared where they are found, so no list of them is kept.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = write_out(words.select("word", F.col("n").cast("long")).where("word IS NOT NULL"), "words")
    both = near_pairs(words).select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")).alias("best")),
                F.struct(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("form")).alias("best")),
            )
        )
    )
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.form")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    found = write_out(found, "forms")
    roots = write_out(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        # Each round doubles how far a root lies; forms grow by ``ratio``, so few rounds do.
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not roots.join(onward, "root", "left_semi").limit(1).count():
            break
        roots = write_out(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
