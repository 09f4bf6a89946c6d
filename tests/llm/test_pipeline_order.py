import corpus_pipeline
from tarn.llm import mixing


def test_run_keeps_the_schedule_over_several_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")  # each stage then writes several files
    try:
        got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "slot", "place").collect()
    finally:
        spark.conf.unset(name)
    want = mixing.mix(spark.createDataFrame(got, "doc_id long, source string, slot long, place int")).orderBy("slot", "place").collect()
    assert len(got) > 800 and [(r["doc_id"], r["slot"], r["place"]) for r in got] == [(r["doc_id"], r["slot"], r["place"]) for r in want]
