"""Quality scores by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import others, ready
from seamark.llm.shingles import SPACE, STEPS, mix, word_hashes
from seamark.session import write_out

#: Bytes of texts that are looked at together; a longer text is read in blocks of this size.
BLOCK = 1 << 20


def _bytes(*ranges: str) -> np.ndarray:
    """Which bytes are in ranges such as ``az``, or are one of the signs of a longer string."""
    out = np.zeros(256, bool)
    for r in ranges:
        out[np.frombuffer(r.encode(), np.uint8) if len(r) != 2 else np.arange(ord(r[0]), ord(r[1]) + 1)] = True
    return out


UPPER, LOWER, DIGIT = _bytes("AZ"), _bytes("az"), _bytes("09")
STOP, PAUSE = _bytes(".!?"), _bytes(",;:")
LINE = np.arange(256) == 10
WIDE = np.arange(256) >= 0x80
HEAD = np.arange(256) >= 0xC0
SYMBOL = ~(UPPER | LOWER | DIGIT | SPACE | STOP | PAUSE | WIDE)
CLASSES = np.stack([UPPER, LOWER, DIGIT, STOP, PAUSE, SYMBOL, HEAD, LINE, SPACE & ~LINE], axis=1)

FEATURES = [
    "log_bytes", "log_words", "log_lines", "upper", "lower", "digit", "stop", "pause", "symbol", "wide", "line", "blank",
    "entropy", "top_byte", "mean_word", "sd_word", "longest_word", "capital_words", "shouted_words", "symbol_words", "bare_symbols",
    "stopped_words", "same_as_last", "words_a_line", "longest_line", "stopped_lines", "distinct_words", "top_word",
    "distinct_pairs", "top_pair", "distinct_lines", "top_line",
]


def blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(bytes, starts, ends, rows, part): runs of whole texts of about ``BLOCK`` bytes, and parts of longer texts.

    A longer text is cut after the last line feed of a block, else after its last
    white space, else after ``BLOCK`` bytes.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        if hi - lo > BLOCK:
            while lo < hi:
                part = data[lo : min(hi, lo + BLOCK)]
                if lo + BLOCK < hi:
                    for cuts in (LINE, SPACE):
                        at = np.flatnonzero(cuts[part])
                        if len(at):
                            part = part[: at[-1] + 1]
                            break
                yield part, np.array([0]), np.array([len(part)]), np.array([row]), True
                lo += len(part)
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(offsets, lo + BLOCK, "right")) - 1)
        own = offsets[row : last + 1] - lo
        yield data[lo : offsets[last]], own[:-1], own[1:], np.arange(row, last), False
        row = last


class Tally:
    """Sums, largest values and repeated items of a batch of texts, added up block by block."""

    SUMS = ("words", "squares", "capital", "shouted", "symbols", "bare", "stopped", "same", "lines", "stopped_lines")

    def __init__(self, count: int) -> None:
        self.bytes = np.zeros((count, 256))
        self.sums = {name: np.zeros(count) for name in self.SUMS}
        self.longest = {"word": np.zeros(count), "line": np.zeros(count)}
        self.kinds = {name: np.zeros((count, 2)) for name in ("words", "pairs", "lines")}  # distinct ones, and the commonest's count
        self.open: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, part: bool) -> None:
        count = len(rows)
        owner = np.repeat(np.arange(count), ends - starts)
        self.bytes[rows] += np.bincount(owner * 256 + data, minlength=count * 256).reshape(count, 256)
        first, last = self._runs(data, starts, SPACE)
        length, sums = last - first, self.sums

        def each(name: str, value: np.ndarray, of: np.ndarray) -> None:
            sums[name][rows] += np.bincount(of, value, minlength=count)

        def inside(kind: np.ndarray) -> np.ndarray:
            """How many bytes of each word are of a kind."""
            seen = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int32)])
            return seen[last] - seen[first]

        own = np.searchsorted(ends, first, "right")
        letters, upper, symbol = inside(UPPER | LOWER | WIDE), inside(UPPER), inside(SYMBOL)
        each("words", np.ones(len(first)), own)
        each("squares", length.astype(float) ** 2, own)
        each("capital", UPPER[data[first]], own)
        each("shouted", (letters > 1) & (upper == letters), own)
        each("symbols", (symbol > 0) & (letters > 0), own)
        each("bare", symbol == length, own)
        each("stopped", STOP[data[last - 1]] if len(last) else np.zeros(0), own)
        np.maximum.at(self.longest["word"], rows[own], length)
        hashes, _ = word_hashes(data, starts, ends)
        near = np.flatnonzero(own[1:] == own[:-1])
        each("same", hashes[near] == hashes[near + 1], own[near])
        self._repeats("words", hashes, own, rows, part)
        self._repeats("pairs", hashes[near] * STEPS[0] + hashes[near + 1] * STEPS[1], own[near], rows, part)
        begin, end = self._runs(data, starts, LINE)
        of = np.searchsorted(ends, begin, "right")
        each("lines", np.ones(len(begin)), of)
        each("stopped_lines", STOP[data[end - 1]] if len(end) else np.zeros(0), of)
        np.maximum.at(self.longest["line"], rows[of], end - begin)
        lines, _ = word_hashes(data, starts, ends, LINE)
        self._repeats("lines", lines, of, rows, part)

    @staticmethod
    def _runs(data: np.ndarray, starts: np.ndarray, between: np.ndarray):
        """First and last + 1 place of every run of bytes that are not ``between``; a text ends a run."""
        inner = ~between[data]
        first = inner.copy()
        first[1:] &= between[data[:-1]]
        edges = starts[starts < len(data)]
        first[edges] = inner[edges]
        after = inner.copy()
        after[:-1] &= between[data[1:]]
        cuts = edges[edges > 0] - 1
        after[cuts] = inner[cuts]
        return np.flatnonzero(first), np.flatnonzero(after) + 1

    def _repeats(self, name: str, items: np.ndarray, own: np.ndarray, rows: np.ndarray, part: bool) -> None:
        if part:
            values, counts = np.unique(items, return_counts=True)
            before = self.open.get((name, int(rows[0])))
            if before is not None:
                values, of = np.unique(np.concatenate([before[0], values]), return_inverse=True)
                counts = np.bincount(of, np.concatenate([before[1], counts])).astype(np.int64)
            self.open[name, int(rows[0])] = values, counts
            self.kinds[name][rows[0]] = len(values), counts.max(initial=0)
            return
        if not len(items):
            return
        marked = mix(items ^ (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(marked)
        sorted_ = marked[order]
        edge = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        of = own[order[edge]]
        distinct, most = np.bincount(of, minlength=len(rows)), np.zeros(len(rows))
        np.maximum.at(most, of, np.diff(np.append(edge, len(items))))
        self.kinds[name][rows] = np.stack([distinct, most], axis=1)

    def features(self) -> np.ndarray:
        """One row of ``FEATURES`` per text; all of an empty text are 0."""
        total = self.bytes.sum(1)
        some, words, lines = np.maximum(total, 1), np.maximum(self.sums["words"], 1), np.maximum(self.sums["lines"], 1)
        share = self.bytes / some[:, None]
        entropy = -(share * np.log2(np.maximum(share, 1e-12))).sum(1)
        visible = self.bytes[:, ~SPACE].max(1) / some
        kinds = self.bytes @ CLASSES / some[:, None]
        length = (total - self.bytes[:, SPACE].sum(1)) / words
        spread = np.sqrt(np.maximum(self.sums["squares"] / words - length**2, 0))
        s = self.sums
        pairs = np.maximum(words - 1, 1)
        columns = [
            np.log1p(total), np.log1p(s["words"]), np.log1p(s["lines"]), *kinds.T, entropy, visible, length, spread,
            np.log1p(self.longest["word"]), s["capital"] / words, s["shouted"] / words, s["symbols"] / words, s["bare"] / words,
            s["stopped"] / words, s["same"] / pairs, s["words"] / lines, np.log1p(self.longest["line"]), s["stopped_lines"] / lines,
        ]
        for name, size in (("words", words), ("pairs", pairs), ("lines", lines)):
            columns += [self.kinds[name][:, 0] / size, self.kinds[name][:, 1] / size]
        return np.stack(columns, axis=1)


def statistics(texts: pa.Array) -> np.ndarray:
    """The statistics of every whole text, a null one counting as empty."""
    tally = Tally(len(texts))
    for block in blocks(texts):
        tally.add(*block)
    return tally.features()


@dataclass
class Forest:
    """Full binary trees of one depth as arrays: node ``i`` of a tree has the children ``2i + 1`` and ``2i + 2``."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The sum of the leaves that each row of ``x`` falls into; all rows go down a tree together."""
        total, line = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and len(x) and at[0] < inner:
                at = 2 * at + 1 + (x[line, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 2.0) -> Forest:
    """Trees boosted on the log loss.

    Values are put into at most ``bins`` bins between their own quantiles. Level by
    level, gradients and Hessians are added up per (node, feature, bin) in one pass,
    and each node is split where that gains most, if both sides keep a Hessian of ``least``.
    """
    n, width = x.shape
    positive = y.sum()
    share = min(max(positive / n, 1e-4), 1 - 1e-4) if n else 0.5
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if not n or positive in (0, n):
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins, method="lower")) for k in range(width)]
    # A value belongs to the first edge that is not below it, so "above the edge" means the same for values and bins.
    codes = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    most = np.array([len(e) for e in edges])
    cell = codes + np.arange(width) * bins
    raw = np.full(n, base)
    feature, threshold, leaf = (np.zeros((trees, k)) for k in (inner, inner, leaves))
    feature = feature.astype(np.int64)
    allowed = np.arange(bins)[None, :] < most[:, None]
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, bend = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            count, first = 2**level, 2**level - 1
            flat = (node[:, None] * (width * bins) + cell).ravel()
            shape = (count, width, bins)
            g = np.bincount(flat, np.repeat(slope, width), minlength=count * width * bins).reshape(shape).cumsum(2)
            h = np.bincount(flat, np.repeat(bend, width), minlength=count * width * bins).reshape(shape).cumsum(2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain = np.where(allowed & (h >= least) & (all_h - h >= least), gain, 0.0).reshape(count, -1)
            best = gain.argmax(1)
            split = gain[np.arange(count), best] > 1e-9
            which, place = best // bins, best % bins
            feature[t, first : first + count] = np.where(split, which, 0)
            # A node that isn't split sends all its rows to the left.
            threshold[t, first : first + count] = [edges[k][b] if s else np.inf for k, b, s in zip(which, place, split, strict=True)]
            right = split[node] & (codes[np.arange(n), which[node]] > place[node])
            node = 2 * node + right
        g, h = (np.bincount(node, v, minlength=leaves) for v in (slope, bend))
        leaf[t] = -rate * g / (h + ridge)
        raw += leaf[t][node]
    return Forest(base, feature, threshold, leaf)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **settings) -> Forest:
    """A forest from ``docs(doc_id, text)`` and ``labels(doc_id, label, pick)``.

    At most ``sample`` labelled ids are used, those of the smallest ``pick``, and of a
    repeated id the text of the smallest hash, so at most ``sample`` rows of
    statistics reach the driver, whatever the corpus. Labels that contradict each other for
    an id, null labels, null ids and null texts teach nothing. Without labels every score is one half.
    """
    ready(docs.sparkSession)
    one = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("label").alias("label"), F.max("label").alias("most"), F.min("pick").alias("pick")
    )
    wanted = write_out(one.where("label = most").orderBy("pick", "doc_id").limit(sample).select("doc_id", "label"), "labelled")
    # Of proven size: ``sample`` pairs of numbers.
    known = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(wanted), "doc_id")

    def measure(batches):
        for batch in batches:
            values = pa.array(statistics(batch.column(3)).ravel())
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(ends, values)], ["doc_id", "label", "hash", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = known.select("doc_id", F.col("label").cast("int"), F.xxhash64("text").alias("hash"), "text")
    rows = rows.mapInArrow(measure, f"doc_id {kind}, label int, hash long, x array<double>")
    found = rows.groupBy("doc_id").agg(F.min_by(F.struct("label", "x"), "hash").alias("row")).select("doc_id", "row.*").toArrow()
    x = found.column("x").combine_chunks().values.to_numpy().reshape(-1, len(FEATURES)) if len(found) else np.zeros((0, len(FEATURES)))
    y = np.array(found.column("label").to_pylist(), np.float64)
    # In an order of their own, as tasks end in any order and sums depend on it.
    order = np.lexsort([*x.T, y])
    return fit(x[order], y[order], **settings)


def score(docs: DataFrame, forest: Forest, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score double`` from 0 to 1, higher for likely good texts, and ``predicted int``, 1 from ``threshold`` on.

    Every whole text is read, long ones in blocks; a null one counts as empty. Other columns pass through, but for
    those of the two names in any case, which are replaced. No shuffle.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(forest)
    kept = others(docs, "score", "predicted")

    def weigh(batches):
        for batch in batches:
            out = shared.value.score(statistics(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(out), pa.array((out >= threshold).astype(np.int32))],
                [*batch.schema.names[1:], "score", "predicted"],
            )

    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")
    return docs.select(F.col(text).cast("string").alias("text to weigh"), *kept).mapInArrow(weigh, schema)
