"""Toxicity scores by a factorisation machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import others, ready
from seamark.llm.shingles import text_chunks, word_hashes
from seamark.session import write_out

#: Buckets that terms are hashed into, and the bytes of a word that make its stem.
BITS, STEM = 20, 4
#: Every ASCII sign but letters and digits stands between words; bytes of other scripts are part of them.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
for _range in ("09", "AZ", "az"):
    BETWEEN[ord(_range[0]) : ord(_range[1]) + 1] = False


@dataclass
class Machine:
    """``bias + sum w x + sum over pairs of <v_i, v_j> x_i x_j`` over the terms a text has."""

    place: np.ndarray  # of each bucket, its place in the model, or -1
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, rows: np.ndarray, places: np.ndarray, count: int) -> np.ndarray:
        """The sum for each of ``count`` texts; text ``rows[i]`` has the term at ``places[i]``."""
        total = np.full(count, self.bias)
        total += np.bincount(rows, self.linear[places], minlength=count)
        for v in self.factors.T:
            sums = np.bincount(rows, v[places], minlength=count)
            total += 0.5 * (sums**2 - np.bincount(rows, v[places] ** 2, minlength=count))
        return total

    def score(self, rows: np.ndarray, places: np.ndarray, count: int) -> np.ndarray:
        """The probability of each text."""
        return sigmoid(self.raw(rows, places, count))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def term_rows(texts: pa.Array):
    """(first row, rows, buckets): the distinct hashed terms of each text, its words and their stems, by row."""
    shift = np.uint64(64 - BITS)
    for first, data, starts, ends in text_chunks(texts):
        words, counts = word_hashes(data, starts, ends, BETWEEN)
        stems, _ = word_hashes(data, starts, ends, BETWEEN, STEM)
        row = np.repeat(np.arange(len(starts)), counts)
        buckets = np.concatenate([words, stems ^ np.uint64(0x5851F42D4C957F2D)]) >> shift
        yield first, len(starts), np.concatenate([row, row]), buckets.astype(np.int64)


#: A model's terms: at most so many, each in at least so many texts, and of a chi-squared above what chance reaches once in a thousand times.
TERMS, LEAST, CHANCE = 4096, 5, 10.83


def telling(texts: np.ndarray, toxic: np.ndarray, n: int, positive: float, terms: int = TERMS, least: int = LEAST) -> np.ndarray:
    """Places of the buckets that tell the labels apart best, from how many texts, and toxic ones, have each."""
    expected = texts * positive / n
    spread = np.maximum(texts * (positive / n) * (1 - positive / n) * (1 - texts / n), 1e-9)
    value = np.where((texts >= least) & (texts < n), (toxic - expected) ** 2 / spread, 0.0)
    chosen = np.sort(np.argsort(-value, kind="stable")[:terms])
    return chosen[value[chosen] > CHANCE]


def fit(
    labelled: list[tuple[int, np.ndarray]], terms: int = TERMS, rank: int = 8, rounds: int = 20, least: int = LEAST, hide: float = 0.3, seed: int = 5
) -> Machine:
    """A machine learnt from (label, distinct buckets) of a bounded sample.

    It has the ``terms`` buckets that tell the labels apart best (chi-squared, in at
    least ``least`` texts), and is fitted by AdaGrad on the log loss with small weight decay. A share ``hide`` of a text's
    terms is hidden at random each time, so that terms which come together as a rule also count alone.
    """
    labels = np.array([y for y, _ in labelled], np.float64)
    sets = [np.asarray(b, np.int64) for _, b in labelled]
    flat = np.concatenate([*sets, np.empty(0, np.int64)])
    place = np.full(1 << BITS, -1, np.int32)
    n, positive = len(labels), labels.sum()
    base = min(max(positive / n, 1e-4), 1 - 1e-4) if n else 1e-4
    if not n or positive in (0, n):
        return Machine(place, float(np.log(base / (1 - base))), np.zeros(0), np.zeros((0, rank)))
    texts = np.bincount(flat, minlength=1 << BITS).astype(np.float64)
    toxic = np.bincount(flat, np.repeat(labels, [len(s) for s in sets]), minlength=1 << BITS)
    chosen = telling(texts, toxic, n, positive, terms, least)
    place[chosen] = np.arange(len(chosen))
    draw = np.random.default_rng(seed)
    linear, factors = np.zeros(len(chosen)), draw.normal(0, 0.02, (len(chosen), rank))
    bias = float(np.log(base / (1 - base)))
    own = [place[s][place[s] >= 0] for s in sets]
    seen_l, seen_f, seen_b = np.full(len(chosen), 1e-6), np.full((len(chosen), rank), 1e-6), 1e-6
    batch = 64
    for _ in range(rounds):
        order = draw.permutation(n)
        for lo in range(0, n, batch):
            some = order[lo : lo + batch]
            rows = np.repeat(np.arange(len(some)), [len(own[i]) for i in some])
            places = np.concatenate([own[i] for i in some])
            seen = draw.random(len(rows)) >= hide
            rows, places = rows[seen], places[seen]
            sums = np.zeros((len(some), rank))
            np.add.at(sums, rows, factors[places])
            square = np.zeros(len(some))
            np.add.at(square, rows, (factors[places] ** 2).sum(1))
            raw = bias + np.bincount(rows, linear[places], minlength=len(some)) + 0.5 * ((sums**2).sum(1) - square)
            error = sigmoid(raw) - labels[some]
            seen_b += (error.sum()) ** 2
            bias -= 0.1 * error.sum() / np.sqrt(seen_b)
            touched, which = np.unique(places, return_inverse=True)
            step = np.bincount(which, error[rows], minlength=len(touched)) + 1e-3 * linear[touched]
            seen_l[touched] += step**2
            linear[touched] -= 0.2 * step / np.sqrt(seen_l[touched])
            push = np.zeros((len(touched), rank))
            np.add.at(push, which, error[rows, None] * (sums[rows] - factors[places]))
            push += 1e-3 * factors[touched]
            seen_f[touched] += push**2
            factors[touched] -= 0.05 * push / np.sqrt(seen_f[touched])
    machine = Machine(place, bias, linear, factors)
    rows, places = np.repeat(np.arange(n), [len(x) for x in own]), np.concatenate(own)
    # With all terms in sight scores are larger than with some hidden, so the bias is set anew for whole texts.
    raw = machine.raw(rows, places, n)
    low, high = -40.0, 40.0
    for _ in range(60):
        shift = (low + high) / 2
        low, high = (shift, high) if sigmoid(raw + shift).sum() < positive else (low, shift)
    machine.bias += shift
    return machine


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, terms: int = TERMS, least: int = LEAST, **settings) -> Machine:
    """A machine from ``docs(doc_id, text)`` and ``labels(doc_id, label, pick)``.

    At most ``sample`` labelled ids are used, those of the smallest ``pick``, and of a repeated id the text of the
    smallest hash. Labels that contradict each other for an id, null labels and null texts teach nothing. The sample's terms
    are counted in the tasks; what reaches the driver is a count for each bucket that ``least`` texts have and, of each text,
    the buckets of the model: at most ``sample`` lists of at most ``terms`` numbers.
    """
    spark = ready(docs.sparkSession)
    one = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("label").alias("label"), F.max("label").alias("most"), F.min("pick").alias("pick")
    )
    wanted = write_out(one.where("label = most").orderBy("pick", "doc_id").limit(sample).select("doc_id", "label"), "labelled")
    # Of proven size: ``sample`` pairs of numbers.
    known = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(wanted), "doc_id")
    kind = dict(docs.dtypes)["doc_id"]

    def found(batches):
        for batch in batches:
            sets = []
            for _, count, rows, buckets in term_rows(batch.column(3)):
                both = np.unique(rows << BITS | buckets)
                edges = np.searchsorted(both >> BITS, np.arange(count + 1))
                sets += [both[lo:hi] & ((1 << BITS) - 1) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            if sets:
                flat, ends = np.concatenate(sets).astype(np.int32), np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(ends, flat)], ["doc_id", "label", "hash", "terms"])

    rows = known.select("doc_id", F.col("label").cast("int"), F.xxhash64("text").alias("hash"), "text")
    rows = rows.mapInArrow(found, f"doc_id {kind}, label int, hash long, terms array<int>")
    rows = write_out(rows, "terms")
    first = rows.groupBy("doc_id").agg(F.min("hash").alias("hash"))
    rows = rows.join(F.broadcast(first), ["doc_id", "hash"]).dropDuplicates(["doc_id"]).select("label", "terms")
    size = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    counted = rows.select("label", F.explode("terms").alias("term")).groupBy("term")
    counts = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).where(F.col("n") >= least).toArrow()
    chosen = np.empty(0, np.int64)
    if size[0] and 0 < size[1] < size[0]:
        # In the order of the buckets, as groups come in any order.
        order = np.argsort(counts.column("term").to_numpy())
        term, n, toxic = (counts.column(c).to_numpy()[order] for c in ("term", "n", "toxic"))
        chosen = term[telling(n.astype(np.float64), toxic.astype(np.float64), size[0], float(size[1]), terms, least)]
    shared = spark.sparkContext.broadcast(np.isin(np.arange(1 << BITS), chosen))

    def keep(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            inside = shared.value[flat] if len(flat) else np.zeros(0, bool)
            ends = np.concatenate([[0], np.cumsum(inside)]).astype(np.int32)[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[inside].astype(np.int32)))], ["label", "terms"])

    table = rows.mapInArrow(keep, "label int, terms array<int>").toArrow()
    told = zip(table.column("label").to_pylist(), (x.values.to_numpy() for x in table.column("terms")), strict=True)
    # In an order of their own, as tasks end in any order.
    return fit(sorted(told, key=lambda r: (r[0], r[1].tobytes())), terms, least=least, **settings)


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` with ``score double`` and ``predicted int``; the text is read whole.

    A null or empty text, or one without known terms, gets the score of the bias
    alone. Other columns pass through, but for those of the two names in any case, which are replaced. No shuffle.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(machine)
    kept = others(docs, "score", "predicted")

    def weigh(batches):
        model = shared.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, count, rows, buckets in term_rows(batch.column(0)):
                places = model.place[buckets]
                known = places >= 0
                both = np.unique(rows[known] * len(model.linear) + places[known])
                each = max(1, len(model.linear))
                out[first : first + count] = model.score(both // each, both % each, count)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(out), pa.array((out >= 0.5).astype(np.int32))],
                [*batch.schema.names[1:], "score", "predicted"],
            )

    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")
    return docs.select(F.col(text).alias("text to weigh"), *kept).mapInArrow(weigh, schema)
