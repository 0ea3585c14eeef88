"""Sharding, exact copies, near copies and the pipeline against plain Python."""

import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seamark.llm import exact_dedup, jaccard_join, sharding
from seamark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(40)]
BASE = " ".join(WORDS)
ODD = [
    (1, "a  b\tc", "en", "x", 6), (2, "a b c", "en", "x", 5), (2, "a b c", "en", "x", 5), (3, None, None, None, None),
    (4, "", "en", "x", 0), (5, " ", "en", "x", 1), (6, " \n ", "en", "x", 3), (None, "a b c", "en", None, 5), (None, None, None, None, None),
    (7, BASE, "en", "x", 1), (8, BASE + " w40", "en", "x", 1), (9, "zz " + BASE, "en", "x", 1), (10, BASE.upper(), "en", "x", 1),
    (11, "one two", "en", "x", 1), (12, "One  TWO", "en", "x", 1), (13, "one", "en", "x", 1), (14, "é" * 3000, "fr", "x", 1),
    (15, "long " * 30000, "en", "x", 1), (16, " ".join(reversed(WORDS)), "en", "x", 1),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def with_clashes(df):
    """Further columns called like the operators' own."""
    names = ["component", "shard", "slot", "row", "record", "bucket", "full_hash", "kept", "n_shingles", "lang_pred", "score", "length", "before", "gone_id", "id"]
    return df.withColumns({n: F.lit(1) for n in names})


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def groups_of(texts, width, percent):
    """(id, set size, smallest linked id, linked rows) of each (id, text), all pairs compared."""
    sets = {}
    for i, (doc, text) in enumerate(texts):
        sets[i] = (doc, shingles(text, width))
    low = {doc: doc for doc, _ in texts if doc is not None}

    def find(a):
        while low[a] != a:
            a = low[a]
        return a

    links = dict.fromkeys(sets, 0)
    for (i, (a, x)), (j, (b, y)) in itertools.combinations(sets.items(), 2):
        if a is None or b is None or not x or not y:
            continue
        if 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            low[hi] = lo
            links[i] += 1
            links[j] += 1
    return sorted(((d, len(s), None if d is None else find(d), links[i]) for i, (d, s) in sets.items()), key=str)


def test_shards(spark, odd, tmp_path):
    docs = with_clashes(odd)
    out = sharding.write_shards(docs, 5, bucket_bytes=1000, path=str(tmp_path / "s"))
    rows = out.collect()
    counts = [sum(r["shard"] == s for r in rows) for s in range(5)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(ODD)
    for s in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    key = lambda r: (str(r["doc_id"]), zlib.crc32((r["text"] or "").encode()), r["text"] is None)
    assert sorted(map(key, docs.collect())) == sorted(key(r["record"]) for r in rows)
    assert out.schema["record"].dataType.names == docs.columns


def test_shards_of_nothing(spark, odd, tmp_path):
    assert sharding.write_shards(odd.limit(0), 3, path=str(tmp_path / "s")).count() == 0


def test_shards_are_shuffled(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = sharding.write_shards(docs, 4, bucket_bytes=4000, path=str(tmp_path / "s")).orderBy("shard", "slot").collect()
    order = [r["record"]["doc_id"] for r in rows]
    assert sorted(order) == list(range(2000))
    rising = sum(a < b for a, b in itertools.pairwise(order))
    assert 900 < rising < 1100
    assert 400 < sum(x >= 1000 for x in order[:1000]) < 600


@pytest.mark.parametrize("hash_all", [False, True])
def test_exact(spark, odd, hash_all):
    found = exact_dedup.exact_dedup(with_clashes(odd), hash_all=hash_all).collect()
    assert len(found) == len(ODD)
    by_text = {}
    for doc, text, *_ in ODD:
        by_text.setdefault(normal(text), []).append(doc)
    of_doc = {}
    for doc, text, *_ in ODD:
        of_doc.setdefault(doc, []).append(by_text[normal(text)])
    for r in found:
        sizes = {len(g) for g in of_doc[r["doc_id"]]}
        assert r["group_size"] in sizes
        lowest = {min((d for d in g if d is not None), default=None) for g in of_doc[r["doc_id"]]}
        assert r["keep_id"] in lowest
    assert sum(r["kept"] for r in found) == len(by_text)


def test_exact_keeps_one_row_of_each_text(spark, odd):
    kept = exact_dedup.drop_copies(with_clashes(odd)).collect()
    assert sorted(normal(r["text"]) for r in kept) == sorted({normal(t) for _, t, *_ in ODD})
    assert {r["doc_id"] for r in kept if normal(r["text"]) == "a b c"} == {1}
    simple = odd.where("doc_id > 2")
    kept = exact_dedup.drop_copies(simple).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 5, *range(7, 17)]
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == exact_dedup.drop_copies(odd.limit(0)).count() == 0


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_against_all_pairs(spark, odd, width, percent):
    found = jaccard_join.jaccard_components(with_clashes(odd), width, percent).collect()
    expected = groups_of([(r[0], r[1]) for r in ODD], width, percent)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in found), key=str) == expected
    assert jaccard_join.jaccard_components(odd.limit(0), width, percent).count() == 0


def near_copies(count, words=60, changes=(0, 1, 2, 3)):
    """Copies of one text with a few words exchanged, in ever other places."""
    out = []
    for i in range(count):
        text = [f"b{k}" for k in range(words)]
        for c in range(changes[i % len(changes)]):
            text[(7 * i + 19 * c) % words] = f"x{i % 11}"
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("listed,block,cells", [(48, 1 << 19, None), (4, 300, None), (2, 1 << 19, 1)])
def test_jaccard_of_a_large_group(spark, monkeypatch, listed, block, cells):
    """Long lists, blocks in parts, and an order that says nothing of frequency give the same links."""
    monkeypatch.setattr(jaccard_join, "LISTED", listed)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    if cells:
        monkeypatch.setattr(jaccard_join, "cell", lambda s: (s >> 63).astype("int64"))
    texts = near_copies(90)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = jaccard_join.jaccard_components(docs, 3, 90).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in found), key=str)
    assert got == groups_of(texts, 3, 90)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_of_repeated_ids(spark, width, percent):
    """Ids with several texts, rows repeated whole, and two sets whose smallest id is the same one."""
    near = near_copies(30, changes=(0, 1))
    texts = [(1, near[0][1]), (1, near[1][1]), (5, near[0][1]), (7, near[1][1]), *[(9, "q r s t u v")] * 4, (None, near[0][1]), (3, near[3][1])]
    texts += [(20 + i % 3, t) for i, t in near] + [(40, None), (41, " "), (42, "q r s t u v")]
    found = jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), width, percent).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in found), key=str)
    assert got == groups_of(texts, width, percent)


def test_jaccard_of_one_id_alone(spark):
    """Two linked texts under one id, and none else."""
    near = near_copies(2, changes=(0, 1))
    texts = [(1, t) for _, t in near]
    found = jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), 3, 90).collect()
    assert [(r["component_id"], r["n_links"]) for r in found] == [(1, 1), (1, 1)]


@pytest.mark.parametrize("block", [1 << 19, 300])
def test_jaccard_pairs(spark, odd, monkeypatch, block):
    """All pairs of different sets with their overlaps, in one block and in many."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    texts = [(r[0], r[1]) for r in ODD] + [(1000 + i, t) for i, t in near_copies(70, words=200, changes=(0, 1))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    pairs, members = jaccard_join.jaccard_pairs(docs, 3, 90)
    of = {}
    for r in members.collect():
        of.setdefault(bytes(r["set"]), set()).add(r["doc_id"])
    distinct = {}
    for doc, text in texts:
        if doc is not None and (words := shingles(text, 3)):
            distinct.setdefault(frozenset(words), set()).add(doc)
    assert sorted(map(sorted, of.values())) == sorted(map(sorted, distinct.values()))
    expected = set()
    for (x, a), (y, b) in itertools.combinations(distinct.items(), 2):
        if 100 * len(x & y) >= 90 * len(x | y):
            expected.add((frozenset([frozenset(a), frozenset(b)]), len(x & y), frozenset([len(x), len(y)])))
    rows = pairs.collect()
    found = {(frozenset([frozenset(of[bytes(r["set_a"])]), frozenset(of[bytes(r["set_b"])])]), r["overlap"], frozenset([r["size_a"], r["size_b"]])) for r in rows}
    assert found == expected and len(rows) == len(expected) > 100
    assert jaccard_join.jaccard_pairs(docs.limit(0), 3, 90)[0].count() == 0


def test_jaccard_blocks_of_long_documents(spark):
    """Long documents that share a passage of some twentieth of their words are in no block with one another, near copies among them are."""
    passages = [[f"p{i}x{k}" for k in range(70)] for i in range(24)]
    texts = [(i, " ".join([*passages[i], *[f"w{i}x{k}" for k in range(1300)], *passages[(i + 1) % 24]])) for i in range(24)]
    texts.append((50, texts[3][1] + " and more"))
    found = jaccard_join._blocked(spark.createDataFrame(texts, "doc_id long, text string"), 3, 90)
    nodes = found.blocks.join(found.classes, "class").select("node").collect()
    assert sorted(r["node"] for r in nodes) == [3, 50]
    links = jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), 3, 90).where("n_links > 0").collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in links) == [(3, 3, 1), (50, 3, 1)]


@pytest.mark.parametrize("percent", [90, 50])
def test_jaccard_of_a_block_of_many_sizes(spark, monkeypatch, percent):
    """A chain of ever longer texts is one component; each text meets only those of near sizes."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 300)
    texts = [(n, " ".join(f"w{k}" for k in range(n + 2))) for n in range(30, 300, 3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = jaccard_join.jaccard_components(docs, 3, percent).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in found), key=str)
    assert got == groups_of(texts, 3, percent)
    rows = jaccard_join.placed(jaccard_join._blocked(docs, 3, percent), percent).collect()
    assert len(rows) == len(texts) and all(r["part"] in r["others"] and len(set(r["others"])) == len(r["others"]) for r in rows)
    for a, b in itertools.combinations(rows, 2):
        if 100 * min(a["size"], b["size"]) >= percent * max(a["size"], b["size"]):
            assert b["part"] in a["others"] and a["part"] in b["others"]
    if percent == 90:  # of 22 levels each text meets three
        assert sum(len(r["others"]) for r in rows) < len(rows) * len({r["part"] for r in rows}) / 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (105, 101), (7, 7), (200, 200)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(51)} == {0} and {found[i] for i in (100, 101, 105)} == {100}
    assert len(found) == 54
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages_keep_columns_and_clean_documents(spark, odd):
    docs = with_clashes(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, odd, "").collect()}
    assert {3, 4, 5, 6}.isdisjoint(kept) and {1, 2, 7, 11, 14, 16} <= kept
    near = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, odd, "").collect()}
    assert near >= {None, 1, 3, 7, 16} and not near & {8, 9, 10}
    last = corpus_pipeline.packed(spark, docs, "")
    assert last.count() >= len(ODD) and corpus_pipeline.packed(spark, docs.limit(0), "").count() == 0


def test_language_stage_keeps_one_word_documents(spark):
    taught = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    words = sorted({(w, r["lang"]) for r in taught for w in (r["text"] or "").split()[:20] if r["lang"] and w.isalpha()})
    rows = [tuple(r) for r in taught] + [(-1 - i, w, lang) for i, (w, lang) in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").select("doc_id").collect()}
    assert len({lang for _, lang in words}) == 4
    assert [w for i, w in enumerate(words) if -1 - i not in kept and len(w[0]) < corpus_pipeline.LEAST_LETTERS] == []
