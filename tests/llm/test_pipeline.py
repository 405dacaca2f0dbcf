"""The pipeline's stages on a small corpus with a known answer."""

import corpus_pipeline
import pytest
from newsloom.llm import mixing

SECRET = "0f1e2d3c4b" * 4


@pytest.fixture()
def folder(spark, tmp_path):
    prose = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 400 and 3000 and lang = 'en'").orderBy("doc_id").limit(12).collect()]
    bench = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(prose)]
    rows += [(50, prose[0] + " Tail.", "en", "s1", 0), (51, None, "en", "s1", 0), (52, "12 34 !!", "en", None, 0), (53, prose[1][:200] + " " + bench, "en", "s1", 0), (54, prose[2][:300] + f' token = "{SECRET}" ' + prose[3], "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    everything = ids(docs)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        before, docs = docs, spark.read.parquet(f"{folder}/{name}")
        seen[name] = ids(docs)
        if name != "source mixing":
            assert docs.columns == before.columns
    assert everything - seen["language ID"] == {51, 52}
    assert seen["language ID"] - seen["near duplicates"] == {50}
    assert seen["near duplicates"] - seen["decontamination"] == {53}
    text = spark.read.parquet(f"{folder}/secret scan").where("doc_id = 54").first()
    assert SECRET not in text.text and "[SECRET]" in text.text and text.n_chars == len(text.text)
    kept = spark.read.parquet(f"{folder}/secret scan")
    mixed = {(r.doc_id, r.copy): r for r in docs.collect()}
    taken = {r.doc_id: r.taken for r in mixing.mix(kept).collect()}
    words = {i: sum(len(r.text.split()) for (k, _), r in mixed.items() if k == i) for i in taken}
    assert words == taken and seen["source mixing"] == {i for i, n in taken.items() if n}
    assert {(r.doc_id, r.copy, r.text) for r in corpus_pipeline.run(spark, folder).collect()} == {(*k, r.text) for k, r in mixed.items()}


def test_rows_that_share_an_id_or_have_none(spark, folder):
    a, b, c = ("".join(f"{w}{k} " for k in range(60)) for w in "abc")
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, a), (1, b), (1, a), (2, b), (None, c), (None, c), (3, a), (4, item), (4, "x " + c[:100]), (None, item), (None, "d e f g h i j")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for x in (df, df.repartition(5)):
        got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, x, folder).collect()]
        assert sorted(map(str, got)) == sorted(map(str, [(1, a), (1, b), (None, c), (4, item), (4, "x " + c[:100]), (None, "d e f g h i j")]))
    left = {(r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, df, folder).collect()}
    assert left == set(rows) - {(4, item), (None, item)}


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_stay(spark, folder):
    """Names that stages use inside, or that Spark would read as paths, come back as they were."""
    names = ["score", "row_key", "_key", "_id", "findings", "size", "copy", "taken", "mix_copy", "_range", "_order", "_t", "lang_pred", "held_out", "row", "group", "c0", "a.b", "target"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(3)
    for name in names:
        docs = docs.withColumn(name, docs.doc_id * 2)
    docs = docs.withColumn("map", __import__("pyspark.sql.functions", fromlist=["x"]).expr("map('k', doc_id)"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/stage{k}")
        columns, docs = docs.columns, spark.read.parquet(f"{folder}/stage{k}")
        more = [c for c in docs.columns if c not in columns]
        assert docs.columns == [*columns, *more] and more == ([] if k < 4 else ["mix_mix_copy", "mix_taken"])
        rows = docs.collect()
        assert rows and all(r[n] == r["doc_id"] * 2 for r in rows for n in names) and all(r["map"] == {"k": r["doc_id"]} for r in rows)


def test_tables_without_source_or_lang_and_rows_that_differ_elsewhere(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, folder).count() > 0
    text = "".join(f"word{k} " for k in range(60))
    rows = spark.createDataFrame([(1, text, s) for s in "cab"], "doc_id long, text string, source string")
    got = {corpus_pipeline.near_duplicates(spark, x, folder).first().source for x in (rows, rows.orderBy("source"), rows.repartition(3))}
    assert len(got) == 1


def test_a_very_long_text(spark, folder):
    long = "".join(f"wordof{k % 977}letters{k % 31} the and of " for k in range(60_000))
    docs = spark.createDataFrame([(1, long, "en", "s", 0), (2, long + "end", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, folder)
    assert [(r.doc_id, r.text) for r in docs.collect()] == [(1, long)]
