"""N-best segmentation into pieces: Viterbi forward, A* backward; and decoding."""

from __future__ import annotations

import heapq
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import others, ready
from seamark.llm.shingles import mix

#: The sign that stands for a space.
SPACE = "▁"
#: Bytes of stretches a worker remembers of late, and as many of before; characters it looks at together, longest stretch that is put in a table with others.
REMEMBERED, CHUNK, TABLED = 48 << 20, 1 << 21, 48
#: Stretches whose best segmentations a worker remembers.
RANKED = 20_000
BASE = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 20


class Lattice:
    """Pieces with scores; the best segmentations of a text have the highest sums.

    Text gets a leading space sign and its spaces become space signs. Between two signs that stand
    next to each other in no piece every segmentation has an edge, before each word for one: texts are cut
    there, the stretches are segmented one by one, and the best of a text are put together from the best of its
    stretches. A character that is no piece can be spelt by its bytes, each ``10`` below the worst piece.
    """

    def __init__(self, model_file: str, best: int = 3) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.best = best
        self.bytes_of: list[bytes] = [b""] * model.get_piece_size()
        self.byte_ids = [0] * 256
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece] = (i, model.get_score(i))
                self.bytes_of[i] = piece.encode()
        self.longest = max(map(len, self.pieces))
        self.byte_score = min(s for _, s in self.pieces.values()) - 10
        self._tabulate()
        self._pair_up()
        self.young: dict[str, tuple[bytes, float, float, bool]] = {}
        self.old: dict[str, tuple[bytes, float, float, bool]] = {}
        self.held = 0
        self.ranked: dict[str, list[tuple[float, bytes, bool]]] = {}

    def _pair_up(self) -> None:
        """A number for each sign of a longer piece, 0 for all others, and which of two stand next to each other in one."""
        longer = [p for p in self.pieces if len(p) > 1]
        signs = sorted(set("".join(longer)))
        self.number = np.zeros(0x110000, np.int16 if len(signs) < 1 << 15 else np.int32)
        self.number[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.signs = len(signs) + 1
        pairs = {(a, b) for p in longer for a, b in zip(p, p[1:])}
        place = [int(self.number[ord(a)]) * self.signs + int(self.number[ord(b)]) for a, b in pairs]
        self.joined = np.zeros(self.signs**2, bool)
        self.joined[place] = True

    def split(self, text: str) -> list[str]:
        """The stretches of a text, space signs for spaces; an empty text has none."""
        if not text:
            return []
        whole = SPACE + text.replace(" ", SPACE)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        number = self.number[points].astype(np.int64)
        cuts = (np.flatnonzero(~self.joined[number[:-1] * self.signs + number[1:]]) + 1).tolist()
        return [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])]

    def _tabulate(self) -> None:
        """Pieces by the hash of their characters: a table of slots, and the sorted hashes for slots of several."""
        texts = list(self.pieces)
        hashes = np.array([int(spans(codes([t]))[0, -1]) for t in texts], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self.ids = np.array([self.pieces[t][0] for t in texts], np.int32)[order]
        self.scores = np.array([self.pieces[t][1] for t in texts])[order]
        self.slots = np.full(1 << SLOTS, -1, np.int32)
        slot = (self.hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        self.slots[slot] = np.arange(len(slot))
        several = np.bincount(slot, minlength=1 << SLOTS) > 1
        self.slots[several] = -2

    def look_up(self, wanted: np.ndarray) -> np.ndarray:
        """Places of hashes among the pieces, -1 for none."""
        at = self.slots[(wanted >> np.uint64(64 - SLOTS)).astype(np.int64)]
        unsure = np.flatnonzero(at == -2)
        if len(unsure):
            at[unsure] = np.minimum(np.searchsorted(self.hashes, wanted[unsure]), len(self.hashes) - 1)
        hit = at >= 0
        hit[hit] = self.hashes[at[hit]] == wanted[hit]
        return np.where(hit, at, -1)

    def viterbi(self, words: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(ids, score, loss to the next segmentation) of words of one length, all at once.

        The next best one departs from the best in some edge, so it is the best of
        all over an edge off the best path: forward score, edge and backward score.
        """
        points = codes(words)
        count, length = points.shape
        prefix = spans(points)
        power = np.cumprod(np.full(length + 1, BASE, np.uint64))
        reach = np.full((length + 1, count), -np.inf)
        reach[0] = 0
        came = np.zeros((length + 1, count), np.int32)
        edges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        size = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        for end in range(1, length + 1):
            for start in range(max(0, end - self.longest), end):
                at = self.look_up(prefix[:, end] - (prefix[:, start] * power[end - start - 1] if start else np.uint64(0)))
                score = np.where(at >= 0, self.scores[at], -np.inf)
                if end == start + 1:
                    score = np.where(at >= 0, score, self.byte_score * size[:, start])
                elif (at < 0).all():
                    continue
                edges[start, end] = (at, score)
                total = reach[start] + score
                better = total > reach[end]
                reach[end] = np.where(better, total, reach[end])
                came[end] = np.where(better, start, came[end])
        back = np.full((length + 1, count), -np.inf)
        back[length] = 0
        for start, end in sorted(edges, reverse=True):
            back[start] = np.maximum(back[start], edges[start, end][1] + back[end])
        on = np.full((length + 1, count), -1, np.int32)  # start of the best path's edge that ends here
        place, line = np.full(count, length), np.arange(count)
        while len(line):
            before = came[place, line]
            on[place, line] = before
            place, line = before[before > 0], line[before > 0]
        second = np.full(count, -np.inf)
        ids = np.full((length + 1, count), -1, np.int32)
        for (start, end), (at, score) in edges.items():
            mine = on[end] == start
            second = np.maximum(second, np.where(mine, -np.inf, reach[start] + score + back[end]))
            ids[end] = np.where(mine, np.where(at >= 0, self.ids[at], -2), ids[end])
        spelt = (ids == -2).any(0)
        lines = np.ascontiguousarray(ids.T)
        inside = lines >= 0
        flat, ends = lines[inside].astype("<u4").tobytes(), (4 * np.cumsum(inside.sum(1))).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for k in np.flatnonzero(spelt):
            own: list[int] = []
            for end in range(1, length + 1):
                if lines[k, end] == -2:
                    own += [self.byte_ids[b] for b in words[k][end - 1].encode()]
                elif lines[k, end] >= 0:
                    own.append(int(lines[k, end]))
            out[k] = np.array(own, "<u4").tobytes()
        return out, reach[length], reach[length] - second

    def learn(self, words: set[str]) -> None:
        """Remember (ids, score, loss to the next segmentation, whether it decodes to it) of stretches not known yet."""
        by_length: dict[int, list[str]] = {}
        for w in words - self.young.keys():
            known = self.old.get(w)
            if known is None:
                by_length.setdefault(len(w), []).append(w)
            else:
                self._keep(w, known)
        for length, group in by_length.items():
            if length > TABLED:
                ranked = [self.segment(w) for w in group]
                found = [r[0][1] for r in ranked], [r[0][0] for r in ranked], [r[0][0] - r[1][0] if len(r) > 1 else np.inf for r in ranked]
            else:
                found = self.viterbi(group)
                for k in np.flatnonzero(found[2] <= 1e-6):  # of equal scores the search decides
                    found[0][k] = self.rank(group[k])[0][1]
                found = found[0], found[1].tolist(), found[2].tolist()
            for w, ids, score, loss in zip(group, *found, strict=True):
                self._keep(w, (ids, score, loss, self.spells(ids, w)))

    def _keep(self, word: str, known: tuple[bytes, float, float, bool]) -> None:
        self.young[word] = known
        self.held += 300 + 4 * len(word) + len(known[0])

    def spells(self, ids: bytes, word: str) -> bool:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]) == word.encode("utf-8", "surrogatepass")

    def edges(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each place the pieces that end there: (start, score, ids)."""
        return [self.into(word, place) for place in range(len(word) + 1)]

    def into(self, word: str, place: int) -> list[tuple[int, float, tuple[int, ...]]]:
        pieces, out = self.pieces, []
        for start in range(max(0, place - self.longest), place):
            found = pieces.get(word[start:place])
            if found is not None:
                out.append((start, found[1], (found[0],)))
        if place and word[place - 1] not in pieces:
            raw = word[place - 1].encode("utf-8", "surrogatepass")
            out.append((place - 1, self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw)))
        return out

    def segment(self, word: str) -> list[tuple[float, bytes]]:
        """The best segmentations of a stretch, the best first; equal scores as the search meets them.

        Forward, the best score up to each place is found. Backward from the end,
        partial segmentations are taken up in the order of their score so far plus
        that best score, which is what they can still reach exactly; those that
        arrive at the start do so from best to worst. Each keeps its last edge and the one it goes on
        from. The edges into a place wait in one entry, the best first, and a place is gone on from as often as
        segmentations are wanted, so the agenda has a few entries for each piece of the best ones.
        """
        reach = array("d", [0.0])
        for place in range(1, len(word) + 1):
            reach.append(max(reach[start] + score for start, score, _ in self.into(word, place)))
        taken = array("L", bytes(8 * (len(word) + 1)))
        found: list[tuple[float, bytes]] = []
        agenda: list[tuple] = []
        met = 0

        def wait(edges: list, k: int, done: float, link: tuple | None) -> None:
            nonlocal met
            met -= 1  # of equals the last, which is nearest to the start
            start, score, _ = edges[k]
            heapq.heappush(agenda, (-(done + score + reach[start]), met, edges, k, done, link))

        def from_place(place: int, done: float, link: tuple | None) -> None:
            wait(sorted(self.into(word, place), key=lambda e: -(e[1] + reach[e[0]])), 0, done, link)

        from_place(len(word), 0.0, None)
        while agenda and len(found) < self.best:
            _, _, edges, k, done, link = heapq.heappop(agenda)
            if k + 1 < len(edges):
                wait(edges, k + 1, done, link)
            start, score, own = edges[k]
            if taken[start] >= self.best:  # the best few ways from a place to the end are all that the best few of all go on from
                continue
            taken[start] += 1
            if start:
                from_place(start, done + score, (own, link))
                continue
            ids, link = [], (own, link)
            while link is not None:
                own, link = link
                ids += own
            found.append((done + score, np.array(ids, "<u4").tobytes()))
        return found

    def rank(self, word: str) -> list[tuple[float, bytes, bool]]:
        found = self.ranked.get(word)
        if found is None:
            if len(self.ranked) > RANKED:
                self.ranked.clear()
            found = [(s, ids, self.spells(ids, word)) for s, ids in self.segment(word)]
            if len(word) <= TABLED:
                self.ranked[word] = found
        return found

    def encode(self, texts: list[str]) -> list[list[tuple[float, bytes, bool]]]:
        """For each whole text its best segmentations, the best first: (score, ids as bytes, whether they decode to it)."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        out = [self._put_together(t, w) for t, w in zip(texts, split, strict=True)]
        if self.held > REMEMBERED:
            self.old, self.young, self.held = self.young, {}, 0
        return out

    def _put_together(self, text: str, words: list[str]) -> list[tuple[float, bytes, bool]]:
        if not words:
            return [(0.0, b"", True)]
        young = self.young
        ids, scores, losses, spelt = zip(*[young[w] for w in words])
        score, loss = sum(scores), np.array(losses)
        # A segmentation among the n best departs from the best one in stretches among the n - 1 of the least loss only.
        departs = np.argsort(loss, kind="stable") if len(loss) < self.best else np.argpartition(loss, self.best - 2)[: self.best - 1]
        choices: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        ranked: dict[int, list[tuple[float, bytes, bool]]] = {}
        for i in sorted(map(int, departs[: self.best - 1])):
            ranked[i] = own = self.rank(words[i])
            wider = [(less + own[0][0] - own[k][0], chosen + (((i, k),) if k else ())) for less, chosen in choices for k in range(len(own))]
            choices = heapq.nsmallest(self.best, wider)
        # Stretches that decode to themselves make up a text that does, unless it holds a space sign of its own.
        same = False not in spelt and SPACE not in text
        whole = b"".join(ids)
        out = []
        for less, chosen in choices:
            if not chosen:
                out.append((float(score - less), whole, same))
                continue
            other = list(ids)
            for i, k in chosen:
                other[i] = ranked[i][k][1]
            out.append((float(score - less), b"".join(other), same and all(ranked[i][k][2] for i, k in chosen)))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces and bytes joined, space signs as spaces, without the leading one. Ids of control signs, or of nothing, are left out."""
        of = self.bytes_of
        text = b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist() if i < len(of)]).decode("utf-8", "replace")
        return text.replace(SPACE, " ").removeprefix(" ")


def codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(words), -1)


def spans(points: np.ndarray) -> np.ndarray:
    """Polynomial hashes of each row's beginnings, modulo 2**64; that of a span is a difference of two."""
    scattered = mix(points + np.uint64(1))
    out = np.zeros((len(points), points.shape[1] + 1), np.uint64)
    for k in range(points.shape[1]):
        out[:, k + 1] = out[:, k] * BASE + scattered[:, k]
    return out


@lru_cache(maxsize=2)
def lattice(model_file: str, best: int) -> Lattice:
    return Lattice(model_file, best)


def nbest(docs: DataFrame, model_file: str, best: int = 3, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """The ``best`` segmentations of every whole text, one row each.

    (key, rank int from 1, score double, n_pieces long, ids array<int>, round_trip boolean). ``round_trip`` says
    whether decoding the ids gives the text back. Texts with fewer segmentations have
    fewer rows. With ``digest`` a checksum (CRC-32 of little-endian unsigned 32-bit ids) stands for the ids. An empty text has one of no pieces, a null one a row with null columns
    and rank 1. A space sign in the text counts as a space, so such a text comes back
    with spaces. Null or repeated ids are kept as they are. A worker's memory of stretches is bounded in bytes, and the late
    ones stay when it is full. No shuffle.
    """
    ready(docs.sparkSession)

    def encode(batches):
        pieces = lattice(model_file, best)
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            lo = 0
            while lo < len(bodies):
                hi, size = lo, 0
                while hi < len(bodies) and (hi == lo or size + len(bodies[hi] or "") <= CHUNK):
                    size += len(bodies[hi] or "")
                    hi += 1
                found = iter(pieces.encode([b for b in bodies[lo:hi] if b is not None]))
                ranked = [[(None, None, None)] if b is None else next(found) for b in bodies[lo:hi]]
                place = np.repeat(np.arange(lo, hi), [len(r) for r in ranked])
                flat = [(rank, *x) for r in ranked for rank, x in enumerate(r, 1)]
                yield rows(batch.column(0).take(pa.array(place)), *zip(*flat, strict=True))
                lo = hi

    def rows(keys, ranks, scores, ids, trips):
        columns = [keys, pa.array(ranks, pa.int32()), pa.array(scores, pa.float64())]
        columns.append(pa.array([None if i is None else len(i) // 4 for i in ids], pa.int64()))
        if digest:
            columns.append(pa.array([None if i is None else zlib.crc32(i) for i in ids], pa.int64()))
        else:
            flat = np.frombuffer(b"".join(i or b"" for i in ids), "<u4").astype(np.int32)
            ends = pa.array(np.cumsum([0, *(len(i or b"") // 4 for i in ids)]).astype(np.int32))
            columns.append(pa.ListArray.from_arrays(ends, pa.array(flat), mask=pa.array([i is None for i in ids])))
        return pa.RecordBatch.from_arrays([*columns, pa.array(trips, pa.bool_())], names)

    last = "ids_crc32" if digest else "ids"
    names = [key, "rank", "score", "n_pieces", last, "round_trip"]
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, rank int, score double, n_pieces long, {last} {'long' if digest else 'array<int>'}, round_trip boolean"
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(encode, schema)


def decode(rows: DataFrame, model_file: str, ids: str = "ids", text: str = "text", best: int = 3) -> DataFrame:
    """``rows`` with ``text``, what their ``ids`` (array<int>) decode to.

    Null ids have a null text, none an empty one; null ids in a list, those of control signs and those the model doesn't have are left out.
    Bytes that are no UTF-8 become replacement signs. Other columns pass through, but for one called like ``text`` in any case, which is replaced. No shuffle.
    """
    ready(rows.sparkSession)
    kept = others(rows, text)

    def spell(batches):
        pieces = lattice(model_file, best)
        for batch in batches:
            lists = batch.column(0).to_pylist()
            texts = [None if x is None else pieces.decode(np.array([i for i in x if i is not None and i >= 0], "<u4").tobytes()) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], text])

    schema = rows.select(*kept).schema.add(text, "string")
    return rows.select(F.col(f"`{ids}`").cast("array<int>").alias("ids to decode"), *kept).mapInArrow(spell, schema)
