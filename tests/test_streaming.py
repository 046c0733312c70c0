from textweir.streaming import progress as P

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def run(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def events(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(*[c.split()[0] for c in EVENTS.split(", ")])
    df.repartition(3).write.parquet(f"{tmp_path}/e")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")


def test_streams_equal_batches(spark, tmp_path):
    df, stream = events(spark, tmp_path)
    for name, f in (("counters", P.counters), ("latest", P.latest)):
        rounded = lambda d: sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in d.collect())
        assert rounded(run(spark, f(stream), name, "complete")) == rounded(f(df))


def test_progress_fold(spark, tmp_path):
    lines = [(1, 0, "Processing: a (1/2)"), (1, 1, "[TR] 2/5 x"), (1, 2, "Done: a -> b"), (1, 3, "Processing: b (2/2)"), (1, 4, "[TR] 1/4 y"), (2, 0, "Processing: c (1/1)"), (2, 1, "noise")]
    df = spark.createDataFrame(lines, "job_id long, seq long, message string")
    df.coalesce(1).write.parquet(f"{tmp_path}/l")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/l")
    got = {r.job_id: (r.files, r.segments_done, r.segments_total) for r in run(spark, P.progress(stream), "folded", "update").collect()}
    assert got == {1: (1, 6, 9), 2: (0, 0, 0)}


def test_cache_flush_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "key_hash string, n long, translation string")
    flush = P.flush_to_cache(f"{tmp_path}/cache", "n")
    flush(rows, 0)
    flush(rows, 0)
    assert sorted((r.key_hash, r.translation) for r in spark.read.parquet(f"{tmp_path}/cache").collect()) == [("a", "x"), ("b", "z")]
