"""Inputs that are too large for one micro-batch are cut into several, without a change in the results."""

import json

from pyspark.sql import functions as F

from runlens.session import work_path
from runlens.streaming import jobs
from runlens.workload import q_streaming as qs


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_events_are_cut_into_ordered_batches(spark, sf, monkeypatch):
    whole = _rows(qs.stream_load_gate(spark, sf))
    monkeypatch.setattr(qs, "BATCH_ROWS", -(-len(whole) // 3))
    names = []
    monkeypatch.setattr(qs, "work_path", lambda s, name: names.append(work_path(s, name)) or names[-1])
    assert _rows(qs.stream_load_gate(spark, sf)) == whole
    written = spark.read.parquet(names[0]).select("event_id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("m"))
    spans = sorted((r.m, r.low, r.high) for r in written.groupBy("f", "m").agg(F.min("event_id").alias("low"), F.max("event_id").alias("high")).collect())
    assert len(spans) >= 3 and all(a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_files_of_a_stream_are_worked_out_once_and_split(spark, monkeypatch):
    monkeypatch.setattr(qs, "BATCH_ROWS", 100)
    names = []
    monkeypatch.setattr(qs, "work_path", lambda s, name: names.append(work_path(s, name)) or names[-1])
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(0, 1000, 1, 4).withColumn("file", F.col("id") % 2).mapInArrow(count, "id long, file long")
    s = qs._files(spark, rows, "id long", "split", 3)
    assert seen.value == 1000  # the rows' own work is not repeated for every file
    sizes = [r["count"] for r in spark.read.parquet(names[0]).groupBy(F.col("_metadata.file_path")).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 150
    assert json.loads(jobs.run_to_table(s, "split-out").agg(F.to_json(F.struct(F.count("*").alias("n"), F.sum("id").alias("s")))).first()[0]) == {"n": 1000, "s": 499500}


def test_larger_history_comes_in_larger_files(spark, tmp_path, monkeypatch):
    k = F.col("id")
    spark.range(0, 12_000, 1, 1).select(
        k.alias("o_orderkey"), (k % 50).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"),
        F.expr("timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(CAST(id % 60 AS INT))").alias("o_orderdate"), F.lit("2-HIGH").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(qs, "INGEST_FILES", 1)
    names = []
    monkeypatch.setattr(qs, "work_path", lambda s, name: names.append(work_path(s, name)) or names[-1])
    ids = spark.range(0, 12_000).selectExpr("CASE WHEN id % 97 = 0 THEN NULL WHEN id % 11 = 10 THEN concat('o', id - 1) ELSE concat('o', id) END AS i").distinct().count()
    assert qs.stream_history_ingest(spark, str(tmp_path)).count() == ids
    assert len(spark.read.text(names[0]).select("_metadata.file_path").distinct().collect()) == 1


def test_a_writer_keeps_a_share_of_its_bytes_from_many_batches(spark):
    from runlens.workload import q_sources as sources  # after the queries whose oracles it shares

    folder = work_path(spark, "prefix")
    lines = [f"line {i} é" for i in range(500)]
    data = "".join(f"{x}\n" for x in lines).encode()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert df.mapInArrow(sources._write_prefix(folder, {0: len(data)}, 2, 3), "n long").agg(F.sum("n")).first()[0] == 500
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    with open(f"{folder}/log-000.txt", "rb") as f:
        assert f.read() == data[: len(data) * 2 // 3]


def test_all_parts_of_a_file_make_one_micro_batch(spark, monkeypatch):
    monkeypatch.setattr(qs, "BATCH_ROWS", 100)
    rows = spark.range(0, 1010, 1, 4).withColumn("file", F.when(F.col("id") < 1000, F.col("id") % 2).otherwise(2))
    s = qs._files(spark, rows, "id long", "aligned", 3)
    batches = []
    checkpoint = work_path(spark, "aligned-checkpoint")
    s.writeStream.foreachBatch(lambda df, epoch: batches.append(sorted(r.id for r in df.collect()))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert batches == [list(range(0, 1000, 2)), list(range(1, 1000, 2)), list(range(1000, 1010))]
