"""The pipeline against plain Python versions of its stages, and the entry points."""

from __future__ import annotations

import corpus_pipeline
from rankloom.llm import quality
from rankloom.llm.queries import WORD_VOCABULARY
from tests.llm import brute
from tests.llm.conftest import prose
from tests.llm.test_other_operators import ids_of


def tables(spark, folder):
    texts = {i: prose(i, 50 + i % 40) + ".\n" + prose(i + 500, 20) + "." for i in range(160)}
    texts |= {1000 + i: " ".join(f"{w.upper()}!!" for w in prose(i, 40).split()) for i in range(60)}
    texts |= {2000: texts[3], 2001: texts[4].replace("w1", "v1", 1), 2002: "head\n" + prose(900, 60), 2003: "other\n" + prose(900, 60) + "\nend",
              2004: prose(700, 30) + " " + prose(800, 25), 2005: texts[5] + " extra"}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, prose(800, 25)), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i in texts if i < 1100], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return texts


def test_run_equals_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    texts = tables(spark, folder)
    judged = quality.report(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    left = {r.doc_id: texts[r.doc_id] for r in judged.where("predicted = 1").collect()}
    assert 150 < len(left) < 180
    shorter, gone = brute.deduplicated_lines(left)
    left = {i: t for i, t in shorter.items() if len(gone[i]) < len(left[i].split("\n"))}
    assert left[2003] == "other\nend" and 2000 not in left and 2004 in left
    copies = brute.near_duplicates(left, 5, 80)
    left = {i: t for i, t in left.items() if copies[i][1] == i}
    left = {i: t for i, t in left.items() if not brute.contamination(t, {1: prose(800, 25)})[1]}
    assert 2004 not in left
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert set(got.doc_id) == set(left)
    for i, part in got.groupby("doc_id"):
        assert part.length.sum() == part.doc_tokens.iloc[0] == len(ids_of(WORD_VOCABULARY, left[i], 1))


def test_stages_keep_the_columns(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20)
    for _, apply in corpus_pipeline.STAGES[:-1]:
        assert apply(spark, docs, folder).columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert apply(spark, docs.limit(0), folder).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]


def test_every_operator_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    sql = __spark_entry__.oracle_sql()
    assert set(sql) <= names and all(isinstance(text, str) for text in sql.values())
