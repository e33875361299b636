import corpus_pipeline
from tests.llm import edge_cases


def test_stages_on_edge_cases(spark, tmp_path):
    labels = [(r[0], i % 4 > 0) for i, r in enumerate(edge_cases.rows()[:30])]
    spark.createDataFrame([(d, int(q), 0) for d, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, docs in (("some", edge_cases.documents(spark)), ("none", edge_cases.empty(spark))):
        path = f"{tmp_path}/{name}"
        docs.write.parquet(f"{path}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{path}/labels.parquet")
        last = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, last, path)
            out.write.parquet(f"{path}/{k}")
            last = spark.read.parquet(f"{path}/{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert last.columns == docs.columns
        assert (last.count() > 0) == (name == "some")


def test_effects_follow_from_stage_to_stage(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))
    base = " ".join(f"w{i}" for i in range(100))
    own, other = (" ".join(f"{letter}{i}" for i in range(70)) for letter in "ab")
    rows = [
        (1, base, "en", "s", 0),
        (2, base + " more", "en", "s", 0),
        (3, f"{own} {passage} tail", "en", "s", 0),
        (4, f"{other} {passage} x.y@z.org", "en", "s", 0),
        (5, "nothing to see", "en", "s", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        got = {r["doc_id"]: r for r in docs.collect()}
        if name == "near_duplicates":
            assert set(got) == {1, 3, 4, 5}
        if name == "substrings":
            assert got[4]["text"] == f"{other} x.y@z.org" and got[3]["text"] == rows[2][1]
        if name == "pii":
            assert got[4]["text"] == f"{other} <EMAIL>"
        if name != "quality" and name != "near_duplicates":
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
