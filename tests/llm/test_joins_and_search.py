"""Jaccard join, lexical search and hard negatives against plain Python versions."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from rankloom.llm import checks, lexical, negatives, setjoin
from tests.compare import difference
from tests.llm import brute
from tests.llm.conftest import prose
from tests.llm.test_text_operators import ODD, documents, near_copies


# --- Jaccard join ---------------------------------------------------------------------------

@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (1, 50)])
def test_join_equals_brute_force(spark, size, percent):
    texts = near_copies()
    # Sets of all small sizes, each with its neighbours one and two words away.
    for n in range(1, 40):
        words = prose(n + 200, n + size - 1).split()
        texts[2000 + 3 * n] = " ".join(words)
        texts[2001 + 3 * n] = " ".join([*words, "more"])
        texts[2002 + 3 * n] = " ".join([*words[:-1], "other"])
    got = setjoin.report(documents(spark, list(texts.items())), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicates(texts, size, percent) and len(got) == len(texts)


def test_join_of_odd_rows(spark):
    texts = [*enumerate(ODD), (None, prose(3, 50)), (7, prose(3, 50) + " x"), (None, "alone"), (7, prose(3, 50)), (2, prose(4, 3000)), (3, prose(4, 3000) + " y")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.report(documents(spark, texts), 4, 85).collect()), key=repr)
    sets = [brute.shingles(t, 4) for _, t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 85 * len(a | b)]
    root = brute.roots(range(len(texts)), links)
    lowest = {}
    for i, (doc, _) in enumerate(texts):
        if doc is not None:
            lowest[root[i]] = min(doc, lowest.get(root[i], doc))
    assert got == sorted(((doc, len(s), lowest.get(root[i])) for i, ((doc, _), s) in enumerate(zip(texts, sets))), key=repr)
    assert setjoin.report(documents(spark, []).limit(0)).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    # A family around one text, most of it too far apart to link, and chains inside it.
    rng, base, texts = random.Random(3), prose(6, 90).split(), {}
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([2, 4, 8])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(40)}"
        texts[i] = " ".join(words)
    monkeypatch.setattr(setjoin, "SMALL", 4)
    monkeypatch.setattr(setjoin, "BLOCK_SETS", 16)
    want = brute.near_duplicates(texts, 4, 85)
    got = setjoin.report(documents(spark, list(texts.items())), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len({c for _, c in want.values()}) > 5


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_every_linked_pair_meets_in_an_allocated_segment(percent):
    """The pigeonhole, whatever the costs: of two linked sets the larger one's allocation meets the other's index."""
    bands, rng = setjoin.Bands(percent), np.random.default_rng(percent)
    for _ in range(150):
        n = int(rng.integers(2, 120))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[rng.integers(0, max(1, n // 8)):], rng.integers(0, 2**63, rng.integers(0, max(2, n // 8))).astype(np.uint64)])
        both = len(set(a.tolist()) & set(b.tolist()))
        if 100 * both < percent * (len(a) + len(b) - both) or set(a.tolist()) == set(b.tolist()):
            continue
        small, large = sorted((np.unique(a), np.unique(b)), key=len)
        parts = setjoin.segment_keys([small, large], np.array([0, 1]), bands)
        key, name, info = (np.concatenate(c) for c in zip(*parts))
        stored = {(k, i & 1) for k, o, i in zip(key.tolist(), name.tolist(), info.tolist()) if o == 0 and i & 2}
        met = False
        for indexed in (0, 1):
            own = (name == 1) & ((info >> 1) & 1 == indexed)
            if not own.any():
                continue
            segment, deleted = (info[own] >> 2) & ((1 << 30) - 1), info[own] & 1
            costs = rng.integers(indexed, 50, own.sum()) * (rng.random(own.sum()) < 0.7) + indexed
            out, wide = setjoin.allocation(segment, deleted, costs, costs, indexed, *bands.spare(len(large), 1 - indexed))
            assert not out & wide
            for k, s, d in zip(key[own].tolist(), segment.tolist(), deleted.tolist()):
                met |= not d and s not in out and (k, 0) in stored
                met |= s in wide and ((k, 0) in stored if d else (k, 1) in stored)
        assert met


def test_allocation_leaves_out_what_costs_most():
    segment, deleted = np.array([0, 1, 2, 3, 0, 0]), np.array([0, 0, 0, 0, 1, 1])
    whole, less = np.array([5, 90, 40, 2, 3, 0]), np.array([1, 0, 0, 0, 0, 0])
    assert setjoin.allocation(segment, deleted, whole, less, 1, 1, 1) == ({1, 2}, {0})  # one for nothing, one for a cost of 4 against 39
    assert setjoin.allocation(segment, deleted, whole, less, 1, 0, 0) == (set(), set())


# --- lexical search -------------------------------------------------------------------------

def ranked(texts, items, k=10):
    words = [brute.words(t) for _, t in texts]
    n_docs, total = sum(bool(w) for w in words), sum(map(len, words))
    df, counts, out = Counter(t for w in words for t in set(w)), [Counter(w) for w in words], []
    for item, text in items:
        scores = []
        for (doc, _), w, tf in zip(texts, words, counts):
            m = 10 + 90 * len(w) * n_docs // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(brute.words(text)) if tf[t])
            if score > 0:
                scores.append((-score, doc is None, doc, score))
        out += [(item, r, doc, score) for r, (_, _, doc, score) in enumerate(sorted(scores, key=lambda x: x[:2] + ((x[2] or 0),))[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, block, k", [(1, 1, 3), (3000, 40, 10), (1 << 24, 1 << 14, 10)])
def test_search_equals_brute_force(spark, shard, block, k):
    rng = random.Random(7)
    texts = [*enumerate(ODD)] + [(100 + i, prose(i % 25, 20 + i % 17) + " the" * (i % 5)) for i in range(80)] + [(None, prose(1, 30)), (101, prose(1, 30)), (101, prose(1, 30))]
    rng.shuffle(texts)
    items = [(1, prose(1, 12)), (2, "the the THE"), (3, None), (4, "  ,;"), (5, "unheard of"), (6, prose(4, 40) + " the"), (None, prose(2, 9)), (7, "ÄÖ É w1x"), (8, prose(1, 12))]
    bench = spark.createDataFrame([(*x, 1, "q") for x in items + [items[0]]], "item_id bigint, text string, item int, terms string")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(documents(spark, texts).repartition(5), bench, k, shard, block).collect()]
    assert sorted(got, key=repr) == ranked(texts, items, k)


def test_search_of_empty_tables(spark):
    docs, bench = documents(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.search(docs.limit(0), bench).count() == 0 and lexical.search(docs, bench.limit(0)).count() == 0
    assert lexical.search(docs.where("doc_id = 2"), bench).count() == 0
    assert [(r.doc_id, r["rank"]) for r in lexical.search(docs, bench).collect()] == [(1, 1)]


def test_accumulators_stop_where_bounds_cannot_reach():
    """Postings of a common term open no accumulator once k better documents are known."""
    lengths = np.full(1000, 10)
    places = np.concatenate([np.arange(5), np.arange(1000)]).astype(np.int32)
    shard = lexical.Searcher(lengths, np.array([7, 9]), np.array([5, 1005]), places, np.ones(1005, np.int32), 1000, 10_000, 90)
    touched = []
    kth = shard._kth
    shard._kth = lambda scores, k: touched.append(len(scores)) or kth(scores, k)
    found, scores = shard.first([7, 9], [9000, 10], np.arange(1000), 3)
    assert list(found) == [0, 1, 2] and len(set(scores.tolist())) == 1 and max(touched) == 5


# --- hard negatives -------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, label int, row int, score string"


def mined(rows, every=100):
    good = [(i, r) for i, r in enumerate(rows) if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = {i: [math.floor(256 * x) if abs(x) < 2**40 else int(x) * 256 for x in r[1]] for i, r in good}
    label = {i: (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2] for i, r in good}
    out = []
    for a, r in good:
        if r[0] % every:
            continue
        pairs = sorted((-sum(x * y for x, y in zip(whole[a], whole[i])), s[0], i) for i, s in good if len(s[1]) == len(r[1]) and i != a)
        pairs = [p for p in pairs if -2**63 <= -p[0] < 2**63]
        for p, name, i in [x for x in pairs if label[x[2]] == label[a]][:5]:
            near = [x for x in pairs if label[x[2]] != label[a] and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(r[0], name, n, x[1], -p, -x[0]) for n, x in enumerate(near, 1)]
    return sorted(out)


def negatives_of(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(3)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in negatives.report(table).collect())


@pytest.mark.parametrize("block, anchors", [(1 << 19, 1 << 16), (300, 12)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, anchors):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", anchors)
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (400, 6)) / 4 + 2 * (rng.random((4, 6)) > 0.5)[rng.integers(0, 4, 400)]  # many ties
    rows = [(i, [float(v) for v in x[i]], int(rng.integers(0, 10))) for i in range(400)]
    rows += [(0, rows[0][1], rows[0][2]), (100, rows[7][1], 3), (5, None, 1), (6, [1.0, None], 1), (8, [math.nan, 1.0], 1), (9, [math.inf, 1.0], 1), (None, [1.0] * 6, 1),
             (10, [1.0] * 6, None), (500, [0.0] * 6, 2), (600, [1.0, 2.0], 1), (601, [1.0, 2.0], 1), (602, [1.0, 1.9], 2), (11, [], 1)]
    assert negatives_of(spark, rows) == mined(rows)


def test_negatives_of_huge_components_and_few_rows(spark):
    rows = [(0, [1e7, 3.0], 1), (1, [1e7, 2.0], 1), (2, [9.9e6 + 0.3, 1.0], 2), (3, [9e6, 1.0], 3), (4, [1e200, 1.0], 2), (5, [1e-300, 1.0], 2), (100, [-1e15, 1.0], 4), (101, [-1e2, 1.0], 4), (102, [-1e2, 1.0], 5)]
    assert negatives_of(spark, rows) == mined(rows) and len(mined(rows)) == 1
    assert negatives_of(spark, rows[:1]) == [] and negatives_of(spark, []) == []


def test_search_checks_hold_on_repeated_rows(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], i % 10) for i in range(250)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    con = duckdb.connect()
    table.write.parquet(str(tmp_path / "e"))
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path / 'e'}/*.parquet')")
    assert difference(negatives.report(table), con, checks.OP13) is None
