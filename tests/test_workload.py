"""What the registered questions build before they answer."""

from pyspark.sql import functions as F

from workload import followed, questions, views

SF = "/root/testdata/sf0.001"


def test_transcript_questions_do_not_build_the_event_store(spark, monkeypatch):
    def build(*args):
        raise AssertionError("the event store was built")

    monkeypatch.setattr(views, "ingest", build)
    assert questions.QUERIES["transcript_files"](spark, SF).count() == 7
    assert questions.QUERIES["transcript_rewrites"](spark, SF).collect()[0]["files"] > 0
    assert not hasattr(followed, "store")


def test_a_table_of_many_splits_and_one_row_group_is_dealt_over_all_cores(spark, tmp_path):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows.coalesce(1).write.option("compression", "none").parquet(f"{tmp_path}/documents.parquet")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        table = views.load_spread(spark, str(tmp_path), "documents")
        per_task = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
        ids = [r["doc_id"] for r in table.select("doc_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(per_task) == 4000 and max(per_task) <= 1000
    assert sorted(ids) == list(range(4000))
