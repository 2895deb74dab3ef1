import corpus_pipeline

from .helpers import WORD


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rows = [(k, " ".join(f"w{(k * 31 + j * 7) % 997}" for j in range(40)), "en", f"s{k % 2}", 0) for k in range(20)]
    item = " ".join(f"z{j}" for j in range(20))
    rows += [(20, rows[3][1], "en", "s0", 0), (21, f"lead {item} tail words", "en", "s1", 0), (22, "ask joe.9@mail.example.com about it", "en", "s1", 0), (23, None, "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert docs.columns == columns, name
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    everything = set(range(24))
    assert seen == [everything, everything - {20}, everything - {20, 21}, everything - {20, 21}]
    assert docs.where("doc_id = 22").first().text == "ask <email> about it"
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(len(WORD.findall(r.text)) == r.n_words and not {20, 21} & set(r.doc_ids) for r in out)
