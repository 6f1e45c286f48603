"""Decontamination, near-duplicates, line dedup and quality against plain Python versions."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import checks, decontaminate, linededup, minhash, quality
from rankloom.llm.components import components
from rankloom.llm.words import ALNUM, SPACED, Words, byte_chunks
from tests.llm import brute
from tests.llm.conftest import prose

DOCS = "doc_id bigint, text string, fp string, row_key int, id int"


def documents(spark, texts):
    """A documents table with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], DOCS)


ODD = [None, "", "   \n\t ", "É", "a" * 5000, "word", "ÄÖ ß 中文 text", "x y"]


@pytest.mark.parametrize("kind, pattern", [(ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (SPACED, r"[^\x20\x09-\x0D]+")])
def test_words_are_those_of_the_pattern(kind, pattern):
    texts = ODD + ["Mixed CASE, words-and more\x1cthings", prose(3, 50)]
    for row, data, at in byte_chunks(pa.array(texts, pa.string()), limit=64):
        words = Words(data, at, kind)
        for i in range(len(at) - 1):
            a, b = words.bounds[i], words.bounds[i + 1]
            assert ([words.text(j, j + 1) for j in range(a, b)]) == brute.words(texts[row + i], pattern)


def test_decontamination_equals_brute_force(spark):
    items = {1: prose(1, 30), 2: prose(2, 10), 3: "tiny item", 4: "one", 5: None, 6: "", 7: prose(1, 30), 8: prose(5, 12)}
    texts = [(i, t) for i, t in enumerate(ODD)]
    texts += [(100, prose(50, 40) + " " + prose(1, 30)[:90] + " " + prose(51, 20)), (101, prose(2, 10).upper()), (102, "a Tiny, item ONE"),
              (103, prose(9, 300) + " " + prose(8, 5)), (104, " ".join([prose(2, 10)] * 3)), (105, prose(2, 9)), (106, prose(1, 30)),
              (107, prose(1, 30)), (None, prose(1, 30)), (108, prose(5, 12)), (108, prose(5, 12))]
    bench = spark.createDataFrame([(k, v) for k, v in items.items()] + [(None, prose(9, 20))], "item_id bigint, text string")
    got = decontaminate.contamination(documents(spark, texts), bench).collect()
    assert len(got) == len(texts)
    # Windows of the item without an id are hits, but no item is met by them.
    met = [(i, *brute.contamination(t, items | {None: prose(9, 20)})) for i, t in texts]
    want = sorted(((i, n, hit, [x for x in ids if x != "None"]) for i, n, hit, ids in met), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=repr) == want
    clean = decontaminate.clean_documents(documents(spark, texts), bench)
    assert clean.columns == ["doc_id", "text", "fp", "row_key", "id"]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _, n, _ in want if not n and i is not None)


def test_a_run_of_one_word_is_extended_in_linear_time(spark):
    bench = spark.createDataFrame([(1, "0 " * 12), (2, prose(2, 10))], "item_id bigint, text string")
    docs = documents(spark, [(1, "0 " * 120_000), (2, "start " + "0 " * 9 + "end"), (3, "0 " * 10 + prose(2, 10))])
    begin = time.time()
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (120_000, 120_000, ["1"]), 2: (11, 0, []), 3: (20, 20, ["1", "2"])} and time.time() - begin < 90


def test_items_without_an_id_contaminate(spark, tmp_path):
    from tests.compare import difference

    import duckdb

    texts = [(1, prose(9, 60)), (2, prose(9, 60) + " " + prose(2, 10)), (3, prose(2, 10)), (4, prose(70, 30)), (5, None)]
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(None, prose(9, 20)), (None, prose(9, 15, 3)), (2, prose(2, 10))], "item_id bigint, text string")
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, bench).collect()}
    assert got[1][0] >= 20 and got[1][1] == [] and got[2][1] == got[3][1] == ["2"] and got[4] == got[5] == (0, [])
    assert {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()} == {4, 5}
    con = duckdb.connect()
    for name, rows in (("documents", docs.select("doc_id", "text")), ("benchmark", bench)):
        rows.write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path / name}/*.parquet')")
    assert difference(decontaminate.report(docs, bench), con, checks.OP1) is None


def test_decontamination_of_empty_tables(spark):
    docs, bench = documents(spark, [(1, "a b")]), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    (row,) = decontaminate.report(docs, bench).collect()
    assert (row.n_hit, row.n_items, row.contaminated) == (0, 0, False)


def near_copies():
    rng, out = random.Random(5), {}
    for g in range(6):
        base = prose(g * 10 + 1, 60 + 20 * g).split()
        for c in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(1000)}"
            out[g * 100 + c] = " ".join(copy)
    out |= {900: out[0], 901: out[0].upper().lower(), 902: "short one", 903: "short one", 904: "Short ONE", 905: "", 906: None, 907: "  ", 908: "solo"}
    return out


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, percent):
    texts = near_copies()
    got = minhash.report(documents(spark, list(texts.items())), size, percent).collect()
    want = brute.near_duplicates(texts, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(texts)
    kept = minhash.one_of_each(documents(spark, [*texts.items(), (None, "null id")]), size, percent)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, root) in want.items() if i == root} | {None}
    assert kept.columns == ["doc_id", "text", "fp", "row_key", "id"]


def test_near_duplicates_of_an_empty_table(spark):
    assert minhash.report(documents(spark, []).limit(0)).count() == 0


def test_a_family_over_several_blocks_loses_no_link(spark):
    # A chain: each text differs from the next in one word, from most others in many.
    words, texts = prose(4, 40).split(), {}
    for i in range(40):
        texts[i] = " ".join(words)
        words[i] = f"new{i}"
    docs = documents(spark, list(texts.items()))
    members = spark.createDataFrame([(1, i, i, 38) for i in texts], "bucket bigint, id bigint, root bigint, n bigint")
    want = {i: root for i, (_, root) in brute.near_duplicates(texts, 3, 85).items()}
    for bound in ({"block": 8}, {"weight": 200}):
        found = [(r.a, r.b) for r in minhash.linked_in_families(docs, members, 3, 85, **bound).collect()]
        assert brute.roots(texts, found) == want


def test_rows_that_repeat_an_id_are_one_document(spark):
    one, two, three = prose(1, 60), prose(2, 60), prose(3, 60)
    texts = [(9, one), (9, two), (4, two + " end"), (7, one), (5, three), (5, ""), (2, three + " end"), (6, None), (6, "alone here now"), (None, one), (None, None)]
    docs = documents(spark, texts)
    rows = minhash.report(docs, 3, 85).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {
        (9, 4, False), (4, 4, True), (7, 4, False), (5, 2, False), (2, 2, True), (6, 6, True), (None, None, True)}
    assert sorted(r.n_shingles for r in rows if r.doc_id == 5) == [0, 58] and len(rows) == len(texts)
    kept = minhash.one_of_each(docs, 3, 85).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 2, 4, 6, 6]


def test_sketches_fill_every_coordinate_and_agree_like_the_sets():
    rng = np.random.default_rng(3)
    sets, near = [], []
    for n in (1, 2, 7, 60, 500):
        a = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        sets.append(a)
    base = np.sort(rng.integers(0, 2**63, 1000).astype(np.uint64))
    for _ in range(40):
        near.append(np.sort(np.concatenate([base[:900], rng.integers(0, 2**63, 100).astype(np.uint64)])))
    filled = minhash.sketches(sets, 64)
    assert (filled != np.iinfo(np.uint64).max).all()
    one, rest = minhash.sketches([base], 128), minhash.sketches(near, 128)
    assert abs((rest == one).mean() - 900 / 1100) < 0.04


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 7: 3, 9: 3}


LINES = [
    (1, "\n".join([prose(1, 25), prose(2, 20), "tail one"])), (2, "\n".join(["head", prose(1, 25), prose(2, 20), "end"])),
    (3, "\n".join([prose(1, 25), "between", prose(2, 20)])), (4, "\n".join([prose(3, 45)] * 3)), (5, None), (6, ""), (7, "\n\n\n"),
    (8, "\n".join([prose(4, 39), "alone"])), (9, "\n".join([prose(4, 39), "alone too"])), (10, prose(5, 41)), (11, prose(5, 41)),
    (12, "\n".join(prose(i, 12) for i in range(20, 40))), (13, "\n".join(prose(i, 12) for i in range(20, 40))),
    (14, "\n".join(prose(i, 12) for i in range(25, 45))), (15, "\n".join(["", prose(6, 30), "", prose(7, 30), ""])),
    (16, "\n".join(["x", prose(6, 30), "", prose(7, 30), "y"])), (17, "\n".join(["ab cd"] * 60)), (18, "\n".join([prose(5, 41), "tail"])), (19, "\n".join([prose(5, 41), "tail"])),
    (20, "\n".join(["\t" + prose(8, 39) + " \f", "one end"])), (21, "\n".join(["\t" + prose(8, 39) + " \f", "other end"])), (22, "\t\n\x0b\n" + prose(9, 45) + "\r"), (23, prose(9, 45) + "\r"),
]


def test_line_dedup_equals_its_check(spark, tmp_path):
    import duckdb

    docs = documents(spark, LINES)
    got = {r.doc_id: (r.lines_before, r.lines_removed, r.text) for r in linededup.report(docs).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", LINES)

    def checked(sql):
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        return {r[names.index("doc_id")]: tuple(r[names.index(c)] for c in ("lines_before", "lines_removed", "text")) for r in rel.fetchall()}

    assert got == checked(checks.OP7)
    every = {r.doc_id: (r.lines_before, r.lines_removed, r.text) for r in linededup.report(docs, 1).collect()}
    assert every == checked(checks.LINE_DEDUP_EVERY_RUN) and every[9][1] == 1 and every[17][1] == 59 and every[20][1] == 0 and every[21][1] == 1
    assert got[2][2] == "head\nend" and got[3][1] == 0 and got[11][1] == 1 and got[13][2] == "" and got[4][1] == 2 and got[18][2] == "tail" and got[19][2] == ""
    left = linededup.with_lines_left(docs.unionByName(documents(spark, [(None, prose(5, 41)), (1, LINES[0][1])])))
    assert {r.doc_id for r in left.collect()} == {i for i, _ in LINES} - {11, 13, 19, 23} | {None}
    assert left.columns == ["doc_id", "text", "fp", "row_key", "id"]


def test_line_dedup_orders_no_deeper_than_its_shortest_runs(spark):
    long = "\n".join(prose(i % 5, 12) for i in range(200))  # suffixes differ only at their ends
    docs = documents(spark, [(1, long), (2, long), (3, "x\n" + long), (3, "x\n" + long)])
    for min_words, levels in ((1, 1), (40, 3)):  # four lines hold 40 words
        places = linededup.repeated(linededup.line_table(docs), min_words)
        assert len(linededup.suffix_array(places)) == levels
        assert places.count() == 600


def test_words_of_a_line(spark):
    bodies = ["", " ", "\t", "a", " a b ", "a  b", "a\tb c", "\x0ba\fb\r", "a\u00a0b", "ä ö  ", " \u3000 "]
    rows = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = {r.body: r.n for r in rows.select("body", linededup.words_in(F.col("body")).alias("n")).collect()}
    assert got == {b: len([w for w in b.translate(str.maketrans("\t\x0b\f\r", "    ")).split(" ") if w]) for b in bodies}


def test_line_dedup_of_empty_and_unrepeated_tables(spark):
    assert linededup.report(documents(spark, []).limit(0)).count() == 0
    (row,) = linededup.report(documents(spark, [(1, "a\nb")])).collect()
    assert (row.lines_removed, row.text) == (0, "a\nb")


def test_quality_of_held_out_documents(spark):
    good = [(i, prose(i, 60) + ".", 1) for i in range(600)]
    bad = [(1000 + i, " ".join(f"{w.upper()}!!" for w in prose(i, 40).split()), 0) for i in range(200)]
    rows = good + bad
    docs = documents(spark, [(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (5002, "  ")])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0), (4, 7, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    judged = [(got[i].predicted, q) for i, _, q in rows if got[i].held_out]
    assert len(judged) > 100 and sum(p == q for p, q in judged) >= 0.97 * len(judged)
    assert got[5000].score == got[5001].score
    kept = quality.accepted(docs, labels)
    assert kept.columns == ["doc_id", "text", "fp", "row_key", "id"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_quality_never_reads_held_out_labels(spark):
    rows = [(i, prose(i, 30), 1) for i in range(200)] + [(500 + i, prose(i, 30).upper(), 0) for i in range(100)]
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    table = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    flipped = table.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in quality.report(docs, t).collect()} for t in (table, flipped))
    assert one == two


def test_quality_without_labels_of_both_classes(spark):
    docs = documents(spark, [(1, "a b c"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert all(r.predicted == 1 for r in quality.report(docs, none).collect())
    bad = spark.createDataFrame([(i, 0) for i in range(1, 20)], "doc_id bigint, quality int")
    assert all(r.predicted == 0 for r in quality.report(docs, bad).collect())
    assert quality.report(docs.limit(0), bad).count() == 0
