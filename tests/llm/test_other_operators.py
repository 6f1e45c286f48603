"""Neighbours, token files, URL filter, personal data, licences and packing."""

from __future__ import annotations

import hashlib
import io
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import licenses, neighbours, packing, pii, tokenfile, urlfilter
from rankloom.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY
from rankloom.llm.tokens import Encoder
from rankloom.session import new_folder, stage
from tests.llm import brute
from tests.llm.conftest import prose

ODD = [None, "", "   \n\t ", "É", "a" * 5000, "x\x00y", "日本 文 text", "İx ŉ", "<|endoftext|> a'b don't I'LL", "a  b\n\n c", "1²3 ¼x", "é e\u0301", "a\x85b \x1c"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", 5, 6) for i, t in texts], "doc_id bigint, text string, content string, part int, score int")


# --- nearest neighbours ---------------------------------------------------------------------

def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24)) + 3 * rng.standard_normal((10, 24))[rng.integers(0, 10, 3000)]
    rows = spark.createDataFrame([(int(i), [float(np.float32(a)) for a in v], "q", 1) for i, v in enumerate(x)],
                                 "vec_id bigint, embedding array<float>, v string, side int")
    good = neighbours.usable(rows, "vec_id", "embedding")
    got = neighbours.search(good, good.where("id % 20 = 0"), 20, block=700, query_block=40).toPandas()
    x = x.astype(np.float32).astype(float)
    found = []
    for q, part in got.groupby("query_id"):
        scores = (x * x[q]).sum(axis=1)
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 21)) and q not in set(part.vec_id)
        assert np.allclose(part.score, scores[part.vec_id], rtol=1e-12)
        assert list(part.vec_id) == list(part.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id)
        scores[q] = -np.inf
        found.append(len(set(np.argsort(-scores)[:20]) & set(part.vec_id)) / 20)
    assert len(found) == 150 and np.mean(found) >= 0.9


def test_vectors_that_take_no_part_ties_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]),
            (40, [None, 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (60, [1.0, 2.0, 3.0]), (8, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.report(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 20, 1.0), (0, 4, 8, 0.5), (20, 1, 0, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 1.0), (20, 4, 8, 0.5)]
    assert neighbours.report(table.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1e-200, 1e-320, 1e200, 1e308])
def test_vectors_of_any_length(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, [float(size * x) if i == 20 else float(x) for x in rng.uniform(-1, 1, 6)]) for i in range(60)] + [(80, [0.5] * 6), (100, [0.5] * 6)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = neighbours.report(table).toPandas()
    assert sorted(got.groupby("query_id").size().items()) == [(q, 20) for q in (0, 20, 40, 80, 100)]
    assert set(got[got.query_id == 80].vec_id) >= {100} and not got.score.isna().any()


# --- tokens ---------------------------------------------------------------------------------

@pytest.mark.parametrize("path", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_ids_are_those_of_the_library(path):
    encode, rng = Encoder(path), random.Random(2)
    signs = "ab Z'st  \n\t.,!?|%é ßÄ0 19²\xa0"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(1500)] + [prose(1, 300)]
    for text, want in zip(texts, encode.library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encode(text), "<u2").tolist() == want.ids, repr(text)


@pytest.mark.parametrize("path", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_added_tokens_get_the_ids_of_the_unmodified_library(path):
    encode, library = Encoder(path), Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n", "x<|startoftext|>y", "A <|EndOfText|> b <|endoftext",
             "é  <|endoftext|>\n\nz", "日本<|endoftext|>文", prose(3, 200) + "<|endoftext|>" + prose(4, 200)]
    for text in [t or "" for t in ODD] + texts:
        assert np.frombuffer(encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(encode("<|endoftext|>")) == 2


def test_normalized_added_tokens_go_to_the_library(tmp_path):
    from tokenizers import AddedToken

    library, path = Tokenizer.from_file(WORD_VOCABULARY), str(tmp_path / "more.json")
    library.add_tokens([AddedToken("Ship It", normalized=True)])
    library.save(path)
    encode = Encoder(path)
    for text in ("we ship it now", "we SHIP\nIT now", "shipping"):
        assert np.frombuffer(encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_added_tokens_in_token_files_and_packing(spark):
    library, texts = {p: Tokenizer.from_file(p) for p in (BYTE_VOCABULARY, WORD_VOCABULARY)}, [(1, "a <|endoftext|> b"), (2, "plain words"), (3, "<|endoftext|>")]

    def want(path, end):
        return {i: np.array([*library[path].encode(t, add_special_tokens=False).ids, end], "<u4") for i, t in texts}

    ids, at = want(BYTE_VOCABULARY, 0), 0
    for r in tokenfile.report(documents(spark, texts), BYTE_VOCABULARY, 0).orderBy("doc_id").collect():
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id]))
        at += r.n_tokens
    ids = want(WORD_VOCABULARY, 1)
    for r in packing.pieces(documents(spark, texts), WORD_VOCABULARY, 1).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length])


def ids_of(path, text, end):
    library = Tokenizer.from_file(path)
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files_round_trip(spark):
    texts = list(enumerate(ODD)) + [(100 + i, prose(i, 80)) for i in range(60)] + [(7, "again")]
    random.Random(1).shuffle(texts)
    docs = documents(spark, texts)
    got = tokenfile.report(docs, BYTE_VOCABULARY, 0).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(i for i, _ in texts)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted((i, zlib.crc32(ids_of(BYTE_VOCABULARY, t, 0))) for i, t in texts)
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == want
    assert tokenfile.report(docs.limit(0), BYTE_VOCABULARY, 0).count() == 0


def test_long_documents_train_the_dictionary(spark):
    texts = [(i, " ".join(prose(i * 50 + j, 100) for j in range(12))) for i in range(40)]
    assert min(len(t) for _, t in texts) > tokenfile.SAMPLE_IDS
    docs = documents(spark, texts)
    raw = tokenfile.train(docs, BYTE_VOCABULARY, 0)
    assert raw and raw == tokenfile.train(docs.repartition(3), BYTE_VOCABULARY, 0)
    (row,) = tokenfile.write(docs.limit(1), BYTE_VOCABULARY, 0, raw, new_folder(spark, "tokens")).collect()
    with open(tokenfile.opened(row.path)[1], "rb") as source:
        assert tokenfile.TokenFile(source, raw).ids(0).size == row.n_tokens
        source.seek(0)
        with pytest.raises(ValueError):
            tokenfile.TokenFile(source, b"")


def test_one_document_is_read_by_seeking(spark):
    texts = [(i, prose(i, 60)) for i in range(300)] + [(77, prose(900, 30)), (None, "no id")] + [(400, prose(1000 + i, 20)) for i in range(300)]
    docs = documents(spark, texts)
    raw = tokenfile.train(docs, BYTE_VOCABULARY, 0)
    files = stage(tokenfile.write(docs, BYTE_VOCABULARY, 0, raw, new_folder(spark, "tokens"), part_bytes=20_000))
    rows = files.orderBy("part", "number").collect()
    # Rows of one id are split as well; each part knows its range of ids.
    assert len(rows) > 3 and sum(r.first_id == r.last_id == 400 for r in rows) >= 1
    for i in (0, 77, 299, 400, None):
        got = tokenfile.document(files, raw, i)
        assert sorted(map(bytes, got)) == sorted(bytes(ids_of(BYTE_VOCABULARY, t, 0).astype("<u2")) for k, t in texts if k == i)
    assert tokenfile.document(files, raw, 12345) == []

    class Counted(io.FileIO):
        reads, taken = 0, 0

        def read(self, n=-1):
            out = super().read(n)
            self.reads, self.taken = self.reads + 1, self.taken + len(out)
            return out

    with Counted(tokenfile.opened(rows[1].path)[1]) as source:
        held = tokenfile.TokenFile(source, raw)
        before, size = source.taken, int(held.ends[5] - held.ends[4])
        assert held.ids(5).size == held.sizes[5]
        assert (source.reads, source.taken) == (3, before + size) and before == 24 * (len(held.sizes) + 1)
        assert source.taken < os.path.getsize(source.name) / 2


def test_one_document_is_read_by_its_index_and_the_dictionary_is_checked():
    import zstandard

    arrays = [np.arange(i, i + 40 + i % 7, dtype="<u2") for i in range(400)]
    raw = tokenfile.trained([a.tobytes() for a in arrays], 4096)
    press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor()
    frames = [press.compress(a.tobytes()) for a in arrays]
    content = tokenfile.file_bytes([None, *range(1, 400)], [len(a) for a in arrays], frames, tokenfile.dictionary_hash(raw))
    held = tokenfile.TokenFile(io.BytesIO(content), raw)
    assert held.ids(237).tolist() == arrays[237].tolist() and held.doc_ids[0] == tokenfile.NO_ID
    with pytest.raises(ValueError):
        tokenfile.TokenFile(io.BytesIO(content), raw + b"x")


def test_packing_covers_every_id_once(spark):
    texts = list(enumerate(ODD)) + [(100 + i, ". ".join(prose(i * 9 + j, 3 + (i * j) % 20) for j in range(30))) for i in range(40)] + [(7, "again"), (500, "word " * 9000)]
    docs = documents(spark, texts).repartition(3)
    rows = packing.pieces(docs, WORD_VOCABULARY, 1, block=20_000).toPandas()
    whole = sorted((i, len(ids_of(WORD_VOCABULARY, t, 1))) for i, t in texts)
    assert rows.length.sum() == sum(n for _, n in whole) and (rows.length > 0).all()
    by_sequence = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    padding = 0
    for _, part in by_sequence:
        assert (part.offset.values == np.concatenate([[0], np.cumsum(part.length)[:-1]])).all()
        n = int(part.length.sum())
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding <= 0.08 * rows.length.sum()
    texts = dict((i, t) for i, t in texts if i != 7)
    for i, part in rows[rows.doc_id != 7].groupby("doc_id"):
        ids = ids_of(WORD_VOCABULARY, texts[i], 1)
        part = part.sort_values("start")
        assert (part.doc_tokens == len(ids)).all() and part.start.iloc[0] == 0
        for s, n, crc in zip(part.start, part.length, part.ids_crc32):
            assert zlib.crc32(ids[s:s + n]) == crc
    assert packing.pieces(docs.limit(0), WORD_VOCABULARY, 1).count() == 0


def cost_of(cuts, inner, size, penalty, each):
    total, last = 0, 0
    for c in cuts:
        n = c - last
        total += (0 if n & (n - 1) == 0 else size - n) + each + penalty * inner[c]
        last = c
    return total


def test_cuts_are_of_least_cost():
    rng = random.Random(4)
    for _ in range(60):
        size = 16
        places = [0]
        while len(places) < 11:
            places.append(places[-1] + rng.randint(1, size))
        inner = [False, *[rng.random() < 0.5 for _ in places[2:]], False]
        flags = dict(zip(places, inner))
        best = min(cost_of([*[p for k, p in enumerate(places[1:-1]) if mask >> k & 1], places[-1]], flags, size, 3, 2)
                   for mask in range(1 << (len(places) - 2))
                   if all(b - a <= size for a, b in zip([0, *[p for k, p in enumerate(places[1:-1]) if mask >> k & 1]],
                                                        [*[p for k, p in enumerate(places[1:-1]) if mask >> k & 1], places[-1]])))
        cuts = packing.cuts_of(np.array(places), np.array(inner), size, 3, 2)
        assert cost_of(cuts, flags, size, 3, 2) == best


# --- URLs -----------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y=/de/", "https://example.net", "https://example.net/en/", "https://x.example.com/de/1#a",
        "https://example.com/fr/", "http://notexample.net/", "http://example.org/fr/?a=1&b=2", "http://a.org?x", "x://u:p@net:80/a", "http://net/", "http://sub.net/q",
        "http://a/b://c.net/", "http://Ä.NET/ü", "://org/fr/", "http://x.org/fr" + "/y" * 3000]


def expected_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:n].translate(brute._FOLD), rest[n:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "s") for i, u in enumerate(URLS)] + [(1, "http://net/", "h", "s")], "page_id bigint, url string, html string, suffix string")
    rows = urlfilter.report(pages).collect()
    assert len(rows) == len(URLS) + 1 and all(r.verdict in ("allow", "block") for r in rows)
    for r in rows:
        if r.page_id != 1:
            host, path, rule, verdict = expected_url(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule) and verdict in (None, r.verdict)
    assert urlfilter.report(pages.limit(0)).count() == 0
    unlabelled = urlfilter.report(pages.where("page_id IN (0, 1, 2) AND NOT url <=> 'http://net/'")).collect()
    assert {r.verdict for r in unlabelled} == {"allow"}


def test_the_trees_learn_from_labelled_urls(spark):
    rows = [(i, f"http://h{i}.net/{'9' * (8 + i % 5)}?a={i}&b=1") for i in range(300)] + [(1000 + i, f"http://site{i}.org/fr/page-{'abc'[i % 3]}") for i in range(300)]
    rows += [(5000 + i, f"http://k{i}.io/{'7' * 11}?a={i}&b=2") for i in range(20)] + [(6000 + i, f"http://other{i}.io/fr/text-{'xyz'[i % 3]}") for i in range(20)]
    got = {r.page_id: r.verdict for r in urlfilter.report(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert sum(got[5000 + i] == "block" for i in range(20)) >= 18 and sum(got[6000 + i] == "allow" for i in range(20)) >= 18


def test_a_label_is_not_among_its_own_features(spark):
    # One labelled URL a suffix: its share must be that of a suffix nobody knows, whatever its own label says.
    rules = [(f"t{i}", "/", "block" if i % 2 else "allow") for i in range(200)]
    rows = spark.createDataFrame([(i, f"http://h.t{i}/{'ab'[i % 7 % 2]}") for i in range(200)], "page_id bigint, url string")
    known = urlfilter.suffix_statistics(urlfilter.featured(urlfilter.ruled(rows, rules)).withColumn("fold", F.lit(3)))
    assert {(r.n, r.n_of[3] - r.n, r.blocked_of[3] - r.blocked) for r in known.collect()} == {(1, 0, 0)}
    # Balanced labels that no feature tells apart are judged near even: an own label among the features would show.
    rows = [(i, f"http://h{i:03d}.io/{'x' * 5}") for i in range(400)]
    rules = [(f"h{i:03d}.io", "/", "block" if i * 7 % 11 < 5 else "allow") for i in range(300)]
    got = urlfilter.judged(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()
    assert sum(abs(r.likely - 0.5) < 0.35 for r in got) >= 380


# --- personal data --------------------------------------------------------------------------

PRIVATE = [
    "mail a.b+c@x-y.example.com, or x@y or @z.de a@b.c_d@e.f a@b.c..d@e.f", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0004 9999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "card 4111111111111111 4111  1111 1111 1111, 12345", "+1 (555) 123-4567 +49.30.123 +1234567890123456 +1 2", "ä€😀 x@y.zz 日本 10.0.0.1 +33 1 23 45 67 89", None, "", "no data at all",
    "5500 0000 0000 0004 5500000000000004 - 1", "+1 (234) 555-0100 9.8.7.6", "\uffff4111\uffff1111 1111 1111 1111", "a@b.c" * 50, "1 2 3 4 5 6 7 8 9 0 " * 400, "+" * 300 + "1", "7" * 4000,
    # Labels, digits and signs by the thousand: no pattern may recurse.  (The plain version takes the square of most of these.)
    "x@" + "a." * 100_000 + "com", "x@" + "a-" * 2000, "+" * 3000 + "1", "1." * 2000, "+1" + " 2" * 3000,
]


def test_base_spans_equal_brute_force(spark):
    got = pii.report(documents(spark, list(enumerate(PRIVATE)) + [(3, PRIVATE[0])])).collect()
    assert len(got) == len(PRIVATE) + 1
    for r in got:
        options = [brute.private_spans(PRIVATE[r.doc_id])] + ([brute.private_spans(PRIVATE[0])] if r.doc_id == 3 else [])
        match = [o for o in options if hashlib.sha256(",".join(o).encode()).hexdigest() == r.base_sha256]
        assert match, (r.doc_id, r.spans, options)
        assert set(match[0]) <= set(filter(None, r.spans.split(",")))
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(match[0])
    assert pii.report(documents(spark, []).limit(0)).count() == 0
    assert [r.spans for r in pii.report(documents(spark, [(1, None), (2, "plain")])).collect()] == ["", ""]


def test_the_method_adds_spans(spark):
    texts = [(i, f"write to user{i}@mail{i % 9}.example.com or call +1 (555) 010-{1000 + i}") for i in range(60)]
    texts += [(100, "contact me (tel: 555-123-4567)"), (101, "login password=abc123def456 ok"), (102, "see page 000-00-0000 of version")]
    got = {r.doc_id: r.spans for r in pii.report(documents(spark, texts)).collect()}
    assert got[100] == "phone:17:29" and got[101].startswith("secret:6:")


def test_reliabilities_prefer_the_labelers_that_agree():
    patterns = [((1, 1, 0, 1), 80), ((1, 1, 0, -1), 15), ((-1, -1, 0, 1), 40), ((-1, -1, 0, -1), 35)]
    prior, skill = pii.reliabilities(patterns)
    assert skill[0][0] > skill[3][0] and pii.likelihood((1, 1, 0, 0), prior, skill) > 0.9 > 0.2 > pii.likelihood((-1, -1, 0, 0), prior, skill)


# --- licences -------------------------------------------------------------------------------

LICENSED = ["Licensed CC-BY 4.0; cc by cc by. ALL rights\nReserved", "the GNU General, Public! License v3", None, "", "ccby cc  by?", "general public licenses",
            "(c) all rights reserved all rights reserved", "cc by" * 3, "É cc by É", "x " * 3000 + "cc by"]


def test_base_phrases_equal_brute_force(spark):
    got = licenses.report(documents(spark, list(enumerate(LICENSED)) + [(0, LICENSED[0])])).collect()
    assert len(got) == len(LICENSED) + 1
    for r in got:
        n, places = brute.base_labels(LICENSED[r.doc_id])
        at = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.report(documents(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("text, labels, value", [
    ("MIT", {"mit"}, 1.0), ("MIT OR GPL-3.0-only", {"mit", "gpl-3.0-only"}, 1.0), ("MIT AND GPL-3.0-only", {"mit", "gpl-3.0-only"}, 0.4),
    ("GPL-2.0 WITH Classpath-exception-2.0", {"gpl-2.0 with classpath-exception-2.0"}, 0.4), ("(MIT OR GPL-2.0) AND MPL-2.0", {"mit", "gpl-2.0", "mpl-2.0"}, 0.6),
    ("MIT AND (", {"mit"}, 1.0), ("MIT OR Apache-2.0 see the file", {"mit", "apache-2.0"}, 1.0), ("((", set(), 0.1), ("LicenseRef-own", {"licenseref-own"}, 0.1),
])
def test_expressions(text, labels, value):
    assert licenses.evaluated(text) == (labels, value)
    found = licenses.scanned(f"// SPDX-License-Identifier: {text}\ncode")
    assert found[2] == labels and found[3] == value


def test_operators_bind_in_order():
    assert licenses.postfix("a or b and c with d".split()) == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.postfix(["(", "a", "or", "b", ")", "and", "c"]) == ["a", "b", "or", "c", "and"]
    assert licenses.postfix(["a", "b"]) is None and licenses.postfix(["or"]) is None
