from pyspark.sql import functions as F

from textloom.sources.tables import table
from textloom.streaming.logs import event_stream, matching_lines, windowed_counts


def test_windowed_counts_equal_the_batch(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(event_stream(spark, str(tmp_path / "in"), events.schema), "ts", "event_type", "1 day", "1 hour")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").count()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, want.collect()))


def test_search_is_the_same_on_streams(spark, sf_dir, tmp_path):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("line_text"))
    pages.write.parquet(str(tmp_path / "in"))
    run = matching_lines(event_stream(spark, str(tmp_path / "in"), pages.schema), "/en/").writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("found").count() == matching_lines(pages, "/en/").count()
