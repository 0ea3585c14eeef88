"""Quality scores, spelling variants and repaired conversations against plain Python."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seamark.llm import conversations, quality, spelling
from seamark.llm.common import held_out
from seamark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "\n\n", "Plain words, and more.\nA second line!\n", "w" * 5000, "a b " * 3000, "%%% $$$", "日本語 テスト。" * 50,
    "naïve café Straße ÀÉÎ ß", "x" * 2_500_000, "one line\n" * 400_000, " " * 1_500_000 + "end.",
]


# Quality -----------------------------------------------------------------------------------------


def plain_statistics(text):
    """A few of the statistics, told word by word."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    lines = [x for x in raw.split(b"\n") if x]
    low = [w.lower() for w in words]
    n = max(1, len(words))
    pairs = list(zip(low, low[1:]))
    return {
        "log_bytes": np.log1p(len(raw)),
        "log_words": np.log1p(len(words)),
        "log_lines": np.log1p(len(lines)),
        "mean_word": sum(map(len, words)) / n,
        "longest_word": np.log1p(max(map(len, words), default=0)),
        "capital_words": sum(w[:1].isupper() for w in words) / n,
        "bare_symbols": sum(re.fullmatch(rb"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", w) is not None and not re.search(rb"[.!?,;:]", w) for w in words) / n,
        "stopped_words": sum(w[-1:] in b".!?" for w in words) / n,
        "same_as_last": sum(a == b for a, b in pairs) / max(1, n - 1),
        "distinct_words": len(set(low)) / n,
        "top_word": max(Counter(low).values(), default=0) / n,
        "distinct_pairs": len(set(pairs)) / max(1, n - 1),
        "stopped_lines": sum(x[-1:] in b".!?" for x in lines) / max(1, len(lines)),
        "longest_line": np.log1p(max(map(len, lines), default=0)),
    }


def test_statistics_against_plain_python():
    texts = [t for t in TEXTS if len(t or "") < 1_000_000 and not re.search("[^\0-\x7f]", t or "")]
    texts += ["Some Words here.\nAND more || more\tmore.", "a\x0bb\x0c c", "same same same"]
    found = quality.statistics(pa.array(texts))
    for text, row in zip(texts, found, strict=True):
        for name, value in plain_statistics(text).items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(value), (name, (text or "")[:40])


def test_statistics_do_not_depend_on_neighbours_or_blocks(monkeypatch):
    texts = [t for t in TEXTS if len(t or "") < 1_000_000]
    together = quality.statistics(pa.array(texts))
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(together, alone)
    lines = "".join(f"line {i % 70} of many.\n" for i in range(500))
    expected = quality.statistics(pa.array([lines]))
    monkeypatch.setattr(quality, "BLOCK", 300)
    found = quality.statistics(pa.array([lines]))
    for name, a, b in zip(quality.FEATURES, found[0], expected[0], strict=True):
        if name not in ("same_as_last", "distinct_pairs", "top_pair"):  # pairs across a cut don't count
            assert a == pytest.approx(b), name


def slow_raw(forest, row):
    total = forest.base
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
        at = 0
        while at < len(feature):
            at = 2 * at + (2 if row[feature[at]] > threshold[at] else 1)
        total += leaf[at - len(feature)]
    return total


def test_trees_learn_an_interaction_and_score_as_a_walk_does():
    draw = np.random.default_rng(1)
    x = np.round(draw.normal(size=(3000, 4)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    forest = quality.fit(x[:2000], y[:2000], trees=40)
    assert ((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    assert forest.raw(x[:50]) == pytest.approx([slow_raw(forest, r) for r in x[:50]])


def test_first_split_is_the_best_one():
    """The first tree of depth one against all cuts of all columns."""
    draw = np.random.default_rng(2)
    x, y = draw.integers(0, 9, (200, 3)).astype(float), draw.integers(0, 2, 200).astype(float)
    forest = quality.fit(x, y, trees=1, depth=1)
    p = y.mean()
    g, h = p - y, np.full(200, p * (1 - p))

    def gain(k, cut):
        sides = [x[:, k] <= cut, x[:, k] > cut]
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in sides) if all(h[s].sum() >= 2 for s in sides) else -1

    best = max((gain(k, c), -k, -c) for k in range(3) for c in np.unique(x[:, k]))
    assert (-best[1], -best[2]) == (forest.feature[0, 0], forest.threshold[0, 0])


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(i if i != 4 else None, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    docs = docs.union(docs.where("doc_id = 9")).withColumns({"Score": F.lit("own"), "label": F.lit("own"), "hash": F.lit(1)})
    labels = spark.createDataFrame([(9, 1, 5), (6, 0, 6), (6, 1, 6), (7, 0, 7), (0, 1, 8), (None, 1, 9)], "doc_id long, label int, pick long")
    forest = quality.learn(docs, labels)
    assert forest.base == 0.0  # of 9 and 7, as 6 contradicts itself and 0 has no text
    found = quality.score(docs, forest).collect()
    assert len(found) == len(TEXTS) + 1 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    scores = {r["doc_id"]: r["score"] for r in found}
    assert scores[0] == scores[1]  # null and empty
    none = quality.learn(docs.limit(0), labels)
    assert quality.score(docs.limit(0), none).count() == 0
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op11_quality"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.95
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert found.count() == docs.count()
    assert found.where(F.col("held_out") != held_out(F.col("doc_id"))).count() == 0
    again = {r["doc_id"]: r["score"] for r in QUERIES["op11_quality"](spark, folder).collect()}
    assert again == {r["doc_id"]: r["score"] for r in found.collect()}


# Spelling variants -------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_variants(counts, ratio=5):
    words, forms = sorted(counts), {}
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    out = {}
    for w in words:
        others = [o for size in (len(w) - 1, len(w), len(w) + 1) for o in by_length[size] if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            forms[w] = best
        out[w] = len(others)
    rows = []
    for w in words:
        root = w
        while root in forms:
            root = forms[root]
        rows.append((w, forms.get(w), root, counts[w], out[w], counts[forms[w]] if w in forms else None))
    return rows


def brute_counts(docs, least, slips):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return counts


@pytest.mark.parametrize(("seed", "letters", "prefix"), [(1, "ab", 5), (2, "abcdé", 5), (3, "abÿ×日", 3), (4, "aab", 9)])
def test_variants_of_random_words(spark, monkeypatch, seed, letters, prefix):
    monkeypatch.setattr(spelling, "PREFIX", prefix)
    draw = random.Random(seed)
    counts = {"".join(draw.choices(letters, k=draw.randint(0, 9))): draw.choice([1, 4, 5, 20, 25, 100, 125, 600]) for _ in range(500)}
    words = spark.createDataFrame([*counts.items(), (None, 3)], "word string, n int").withColumn("a", F.lit("own"))
    found = [tuple(r) for r in spelling.spelling_variants(words).collect()]
    assert sorted(found) == brute_variants(counts)
    pairs = [tuple(sorted(r)[:]) for r in spelling.near_pairs(words).select("a", "b").collect()]
    assert len(pairs) == len(set(pairs)) == sum(r[4] for r in found) // 2


def test_variants_of_long_words_and_none(spark):
    long = "abcdefghij" * 200
    counts = {long: 100, long[1:]: 5, long + "x": 20, "x" * 3000: 7, "x" * 3001: 1000, "": 1, "a": 9, "z" * 100_000: 5, "z" * 99_999 + "y": 50}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(tuple(r) for r in spelling.spelling_variants(words).collect()) == brute_variants(counts)
    assert spelling.spelling_variants(words.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(words, ratio=1)


@pytest.mark.parametrize("slips", [None, 3])
def test_word_counts(spark, monkeypatch, slips):
    monkeypatch.setattr(spelling, "SLICE", 7)
    monkeypatch.setattr(spelling, "ENTRIES", 3)
    docs = [(1, "Hello hello HELLO wörld Äpfel ÄPFEL x×y÷z don't"), (None, "hello abc-def\nhello"), (2, None), (2, ""), (2, "hello" * 9), (2, "日本abcdeß ﬁx abcdeſ")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("own"))
    found = {r["word"]: r["n"] for r in spelling.word_counts(rows, least=3, slips=slips).collect()}
    assert found == brute_counts(docs, 3, slips)


def test_pivots_are_the_cheapest_disjoint_pair():
    draw = random.Random(5)
    for _ in range(300):
        places = sorted(draw.sample(range(12), draw.randint(3, 7)))
        left, right = ([draw.randint(0, 9) for _ in places] for _ in "ab")
        one, two = spelling.pivots(places, left, right)
        assert places[one] + 2 <= places[two]
        pairs = [(i, j) for i, j in itertools.combinations(range(len(places)), 2) if places[i] + 2 <= places[j]]
        assert left[one] + right[two] == min(left[i] + right[j] for i, j in pairs)


def test_registered_variants(spark):
    found = sorted(tuple(r) for r in QUERIES["op12_spelling_variants"](spark, FOLDER).collect())
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    counts = {w: n for w, n in brute_counts(docs, 6, 199).items() if n >= 5}
    assert len(found) > 100 and found == brute_variants(counts)


# Conversations -----------------------------------------------------------------------------------

WHITE = "\t\n\x0b\x0c\r "


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out[conv]
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """All edits by one queue ordered by (cost, audit), state by state: Dijkstra with the audit as part of the distance."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[1][:1] for r in rows]
    result = [max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")]]
    result.append(sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])))
    queue, done = [(0, "", 0, "", ())], set()
    speaker = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    while True:
        cost, audit, i, last, left = heapq.heappop(queue)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            body = "\n".join(f"{r}:{t}" for r, t in left)
            return (*result, cost, audit, hashlib.sha256(body.encode()).hexdigest())
        then = speaker[last]
        heapq.heappush(queue, (cost + 5, audit + "I", i, then[0], (*left, (then, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, last, left))
            if faults[i] in ("", "truncated"):
                more = cost + (5 if faults[i] else 0)
                heapq.heappush(queue, (more + 1, audit + "R", i + 1, then[0], (*left, (then, text))))
                if role[:1] == then[0] or (role[:1] == "s" and not last):
                    heapq.heappush(queue, (more, audit + "K", i + 1, role[:1], (*left, (role, text))))


def plain_results(rows):
    return {conv: plain_repair(own) for conv, own in plain_damage(rows).items()}


def drawn_conversations(seed, count, longest):
    draw = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, " "]
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t\n", None, "end. \n", "a.b", " ", "é?"]
    rows = []
    for conv in range(count):
        for turn in range(draw.randint(0, longest)):
            rows.append((conv or None, draw.choice([turn, turn, turn + 3, None, turn // 2]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"text {draw.randint(0, 99)}."))
    return rows


def results(spark, rows, partitions=8):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("own")).repartition(partitions)
    found = conversations.repair(conversations.damage(df)).collect()
    assert len(found) == len({r[0] for r in rows})
    return {r["conv_id"]: tuple(r)[1:] for r in found}


@pytest.mark.parametrize(("seed", "rows", "size"), [(1, 1024, 1 << 22), (2, 2, 1 << 22), (3, 3, 1 << 22), (4, 1024, 12)])
def test_repair_against_plain_search(spark, monkeypatch, seed, rows, size):
    """Whole conversations, and ones that are cut into parts by rows or by bytes."""
    monkeypatch.setattr(conversations, "ROWS", rows)
    monkeypatch.setattr(conversations, "BYTES", size)
    drawn = drawn_conversations(seed, 120, 9)
    assert results(spark, drawn) == plain_results(drawn)


def test_repair_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversations, "ROWS", 50)
    draw = random.Random(9)
    rows = [(7, t, draw.choice(["user", "assistant"]), draw.choice(["same.", f"t{t}.", f"t{t}"])) for t in range(700)]
    rows += [(8, 0, "user", "Hello."), (8, 1, "assistant", "x" * 1_000_000 + ".")] + [(9, 5, "user", "same row.")] * 200
    assert results(spark, rows) == plain_results(rows)


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damage(df)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert results(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_registered_repairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, FOLDER).collect()}
    assert found == plain_results(rows)
