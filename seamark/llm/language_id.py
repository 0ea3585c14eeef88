"""Language identification by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import frugal, others, ready

UNKNOWN = "und"
#: Letters of an n-gram, dimensions of a vector, the seed of the letters' vectors.
ORDER, DIMENSIONS, SEED = 3, 1024, 20240117
#: Characters that are looked at together, and n-grams whose vectors are held at a time.
CHUNK, BLOCK = 1 << 19, 8192
#: Stands for whatever is between words.
GAP = 0


class Letters:
    """Whether a code point is part of a word (2 a letter, 1 a mark), and its random vector of -1 and 1; both made when first needed."""

    def __init__(self, dimensions: int, seed: int) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.known = np.full(0x110000, -1, np.int8)
        self.vectors: dict[int, np.ndarray] = {}

    def kind(self, points: np.ndarray) -> np.ndarray:
        found = self.known[points]
        if (found < 0).any():
            for p in np.unique(points[found < 0]):
                self.known[p] = {"L": 2, "M": 1}.get(unicodedata.category(chr(p))[0], 0)
            found = self.known[points]
        return found

    def vector(self, point: int) -> np.ndarray:
        if point not in self.vectors:
            draw = np.random.Generator(np.random.Philox(key=[self.seed, point]))
            self.vectors[point] = draw.integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return self.vectors[point]

    def ngrams(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams (rows of code points): the product of the letters' vectors, each turned by its place from the end."""
        points, where = np.unique(grams, return_inverse=True)
        where = where.reshape(grams.shape)
        letters = np.stack([self.vector(int(p)) for p in points])
        out = np.ones((len(grams), self.dimensions), np.int8)
        for k in range(grams.shape[1]):
            out *= np.roll(letters, grams.shape[1] - 1 - k, axis=1)[where[:, k]]
        return out.astype(np.float32)


def profiles(texts: list[str | None], letters: Letters) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bundled vectors, letters per text) of runs of texts with about ``CHUNK`` characters.

    Vectors of at most ``BLOCK`` n-grams exist at a time, so a long text of very many kinds takes memory for its characters only.
    """
    row = 0
    while row < len(texts):
        last, size = row, 0
        while last < len(texts) and (last == row or size + len(texts[last] or "") <= CHUNK):
            size += len(texts[last] or "")
            last += 1
        # Two gaps between texts, so that no n-gram holds letters of two.
        joined = "\0\0".join((t or "").lower() for t in texts[row:last])
        points = np.frombuffer(("\0" + joined + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        kind = letters.kind(points)
        is_letter = kind > 0
        lengths = np.array([len((t or "").lower()) for t in texts[row:last]])
        owner = np.repeat(np.arange(last - row), lengths + 2)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # the first sign after a word is its gap
        keep[np.cumsum(lengths + 2) - lengths - 2] = True  # and so is the start of a text
        n_letters = np.bincount(owner[kind == 2], minlength=last - row)
        points, owner, is_letter = np.where(is_letter, points, GAP)[keep], owner[keep], is_letter[keep]
        out = np.zeros((last - row, letters.dimensions), np.float32)
        if len(points) >= ORDER:
            symbols, code = np.unique(points, return_inverse=True)
            base = len(symbols)
            packed = code[:-2] * base**2 + code[1:-1] * base + code[2:]
            whole = (owner[:-2] == owner[2:]) & is_letter[1:-1]
            packed, of = packed[whole], owner[:-2][whole]
            kinds, which = small_unique(packed, base**ORDER)
            order = np.argsort(which, kind="stable") if len(kinds) > BLOCK else None
            if order is not None:
                which, of = which[order], of[order]
            for low in range(0, len(kinds), BLOCK):
                some = kinds[low : low + BLOCK]
                mine = slice(*np.searchsorted(which, [low, low + BLOCK])) if order is not None else slice(None)
                grams = np.stack([symbols[some // base**2], symbols[some // base % base], symbols[some % base]], axis=1)
                add(out, of[mine], which[mine] - low, letters.ngrams(grams))
        yield row, out, n_letters
        row = last


def add(out: np.ndarray, of: np.ndarray, which: np.ndarray, vectors: np.ndarray) -> None:
    """Add to each text's row of ``out`` the vectors of its n-grams, a block of rows at a time."""
    order = np.argsort(of, kind="stable")
    of, which = of[order], which[order]
    step = max(1, (1 << 20) // len(vectors))
    edges = np.searchsorted(of, np.arange(0, len(out) + step, step))
    for k, lo in enumerate(range(0, len(out), step)):
        hi = min(len(out), lo + step)
        part = slice(edges[k], edges[k + 1])
        cells = (of[part] - lo) * len(vectors) + which[part]
        counts = np.bincount(cells, minlength=(hi - lo) * len(vectors)).reshape(hi - lo, -1)
        out[lo:hi] += counts.astype(np.float32) @ vectors


def small_unique(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with inverse; by a table where the values allow it."""
    if limit > 1 << 22:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(limit, bool)
    seen[values] = True
    kinds = np.flatnonzero(seen)
    place = np.zeros(limit, np.int32)
    place[kinds] = np.arange(len(kinds))
    return kinds, place[values]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-12)


def learn(
    docs: DataFrame, per_language: int = 2000, seed: int = SEED, dimensions: int = DIMENSIONS, most: int = 1000
) -> dict[str, np.ndarray]:
    """A prototype for each value of ``lang``: the bundle of its documents' unit vectors.

    ``docs`` has ``text``, ``lang`` and ``pick``, a number that decides which rows are
    taken: of each language those with the smallest ones, about ``per_language`` of
    them. This bounds what is learnt from; all else reads every row. More than ``most`` languages raise,
    as they would all reach the driver and every task.
    """
    ready(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().limit(most + 1).collect()}
    if not counts:
        return {}
    if len(counts) > most:
        raise ValueError(f"more than {most} languages")
    # The share of the range of ``pick`` that holds the wanted number of rows.
    cuts = [(lang, int(min(1.0, per_language / n) * (2**32 - 1))) for lang, n in sorted(counts.items())]
    taken = F.lit(False)
    for lang, cut in cuts:
        taken = taken | ((F.col("lang") == lang) & (F.col("pick") <= cut))

    def bundle(batches):
        letters, sums = Letters(dimensions, seed), {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for row, vectors, _ in profiles(batch.column(0).to_pylist(), letters):
                own = langs[row : row + len(vectors)]
                for lang in set(own):
                    sums[lang] = sums.get(lang, 0) + unit(vectors[own == lang]).sum(0, np.float64)
        for lang, total in sums.items():
            parts = [pa.array([range(dimensions)], pa.list_(pa.int32())), pa.array([total], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([lang]), *parts], ["lang", "place", "sum"])

    parts = usable.where(taken).select("text", "lang").mapInArrow(frugal(bundle), "lang string, place array<int>, sum array<double>")
    sums = parts.select("lang", F.explode(F.arrays_zip("place", "sum")).alias("x")).groupBy("lang", "x.place").agg(F.sum("x.sum").alias("sum"))
    found: dict[str, np.ndarray] = {}
    for row in sums.collect():
        found.setdefault(row["lang"], np.zeros(dimensions))[row["place"]] = row["sum"]
    return dict(sorted(found.items()))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", seed: int = SEED) -> DataFrame:
    """``docs`` with ``lang_pred string`` and ``score double``, the cosine with the nearest prototype.

    ``und`` with score 0 for a null text, one without a letter (marks alone are none), or if nothing was learnt.
    Other columns pass through, but for those of the two names in any case, which are replaced. No shuffle.
    """
    spark = ready(docs.sparkSession)
    names = list(prototypes)
    dimensions = len(next(iter(prototypes.values()))) if names else DIMENSIONS
    weights = spark.sparkContext.broadcast(unit(np.array([prototypes[n] for n in names])).astype(np.float32) if names else None)
    kept = others(docs, "lang_pred", "score")

    def compare(batches):
        letters = Letters(dimensions, seed)
        for batch in batches:
            best, scores = [], []
            for _, vectors, n_letters in profiles(batch.column(0).to_pylist(), letters):
                if not names:
                    best += [UNKNOWN] * len(vectors)
                    scores += [0.0] * len(vectors)
                    continue
                cosine = unit(vectors) @ weights.value.T
                at = cosine.argmax(1)
                score = np.clip(cosine[np.arange(len(at)), at].astype(np.float64), 0.0, 1.0)
                best += [names[i] if n else UNKNOWN for i, n in zip(at, n_letters, strict=True)]
                scores += np.where(n_letters > 0, score, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(best, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names[1:], "lang_pred", "score"],
            )

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(F.col(text).alias("text for profile"), *kept).mapInArrow(frugal(compare), schema)


def picked(doc_id: Column) -> Column:
    """A number below 2**32 spread evenly over ids."""
    return F.pmod(F.xxhash64(F.lit(SEED), doc_id), F.lit(1 << 32))
