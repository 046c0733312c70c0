import corpus_pipeline

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names, seen = docs.columns, [docs.count()]
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        made = f(spark, docs, DIR)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == names, name
            made.write.parquet(f"file://{tmp_path}/{k}")
            docs = spark.read.parquet(f"file://{tmp_path}/{k}")
            seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > seen[0] / 2
    packed = made.groupBy("doc_id").count()
    assert packed.count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, DIR).count() == made.count()


def test_odd_documents_go_through_every_stage(spark, docs, texts, tmp_path):
    """Nulls, empty, very long and repeated texts, no ids, and columns with the operators' own names."""
    sf = f"file://{tmp_path}/odd"
    good = [i for i, t, _ in texts if i is not None and i < 120]
    spark.createDataFrame([(i, 1, 0, "clash") for i in good] + [(400, 0, 1, None), (None, 1, 0, "x"), (403, None, None, "x")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, texts[7][1], "clash"), (2, "", None), (3, None, None), (None, "no id here at all", None)], "item_id long, text string, doc_id string").write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    now, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = f(spark, now, sf)
        assert now.columns == docs.columns and dict(now.dtypes) == dict(docs.dtypes), name
        now.write.parquet(f"{sf}/{k}")
        now = spark.read.parquet(f"{sf}/{k}")
        kept.append([r.doc_id for r in now.select("doc_id").collect()])
    assert not {400, 401} & set(kept[0])
    assert not {402, 403} & set(kept[1])
    assert len([i for i in kept[2] if i is not None and 200 <= i < 225]) + (3 in kept[2]) == 1 and 406 in kept[2]
    assert 7 in kept[2] and 7 not in kept[3]
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(kept[3]) and len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert sum(r.length for r in out if r.doc_id == 406) > 30_000


def test_nothing_goes_through(spark, no_docs, tmp_path):
    sf = f"file://{tmp_path}/none"
    no_docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
