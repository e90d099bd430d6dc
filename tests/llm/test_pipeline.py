import corpus_pipeline
from skein.llm import quality
from tests.llm.test_operators import SPACE, near_components


def test_pipeline_against_brute_force(spark, rows, docs, tmp_path):
    """Quality scores are taken from the operator; every later stage is held against plain Python."""
    junk = [(10_000 + i, " | ".join(f"w{j}!!" for j in range(5 + i % 7)), None, "b", None, "", "", "", "", "") for i in range(60)]
    both = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    labels = spark.createDataFrame([(r[0], 0) for r in junk] + [(r[0], 1) for r in rows], "doc_id long, quality int")
    both.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    frames = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        frames.append(spark.read.parquet(str(tmp_path / f"stage{i}")))
    for f in frames[1:-1]:
        assert f.columns == both.columns
    ids = [sorted(r["doc_id"] for r in f.select("doc_id").collect()) for f in frames]
    model = quality.train(both, labels)
    passed = {r["doc_id"] for r in quality.scored(both, model).where("predicted = 1").collect()}
    assert ids[1] == sorted(passed) and not any(i >= 10_000 for i in ids[1])
    text = {r[0]: r[1] for r in rows}
    firsts: dict[str, int] = {}
    for d in ids[1]:
        firsts.setdefault(SPACE.sub(" ", text[d] or ""), d)
    assert ids[2] == sorted(firsts.values())
    near = near_components([(d, text[d]) for d in ids[2]], 5)
    assert ids[3] == sorted(d for d, v in near.items() if v[2])
    assert set(ids[4]) <= set(ids[3]) and max(map(ids[4].count, ids[4])) <= 3
    assert len(ids[5]) == len(ids[4]) and frames[5].where("not lossless").isEmpty()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[5])


def test_pipeline_of_odd_tables(spark, tmp_path):
    """An empty table, rows without ids or text, repeated rows, and further columns with names that stages use inside."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _key string, _copies string, th string"
    long = "one two three four five six seven eight nine ten"
    rows = [(None, long, None, None, 1, "k", "c", "t"), (None, long, None, None, 1, "k", "c", "t"), (5, None, "en", "a", 2, "k", "c", "t"), (5, "", "en", "a", 2, "k", "c", "t"), (6, long + " eleven", "en", "a", 3, "k", "c", "t"), (7, "x" * 70_000, "en", "b", 4, "k", "c", "t")]
    for name, some in (("empty", []), ("odd", rows)):
        folder = str(tmp_path / name)
        spark.createDataFrame(some, kinds).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns
        out = corpus_pipeline.run(spark, folder)
        assert out.where("not lossless").isEmpty() and (out.count() == 0) == (name == "empty")
