from pyspark.sql import functions as F

from plumbline.sources import topic
from plumbline.streaming import source


def write(spark, folder, path, checkpoint, writer="w"):
    stream = source.file_source(spark, folder, "key string, value string", files_per_batch=1)
    query = topic.topic_sink(stream, path, writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read(spark, path, out, checkpoint, starting="latest"):
    query = topic.topic_source(spark, path, starting).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(r["key"] for r in spark.read.schema("key string, value string").parquet(out).collect())


def test_a_topic_is_read_once_over_restarts_and_from_the_latest(spark, tmp_path):
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "topic", "c"))

    def put(low, high):
        spark.range(low, high, 1, 2).select(F.col("id").cast("string").alias("key"), F.repeat(F.lit("é\n"), 3).alias("value")).coalesce(1).write.mode(
            "append").parquet(folder)

    put(0, 10)
    put(10, 20)
    write(spark, folder, path, checkpoint)
    keys = lambda low, high: sorted(str(i) for i in range(low, high))
    assert read(spark, path, str(tmp_path / "all"), str(tmp_path / "c1"), "earliest") == keys(0, 20)
    assert read(spark, path, str(tmp_path / "new"), str(tmp_path / "c2")) == []
    put(20, 35)
    write(spark, folder, path, checkpoint)
    assert read(spark, path, str(tmp_path / "all"), str(tmp_path / "c1"), "earliest") == keys(0, 35)
    assert read(spark, path, str(tmp_path / "new"), str(tmp_path / "c2")) == keys(20, 35)


def test_an_epoch_that_runs_again_adds_nothing_and_an_aborted_one_is_not_there(tmp_path):
    writer = topic.TopicWriter(topic._Topic(str(tmp_path / "t")), "w")
    reader = topic.TopicReader(topic._Topic(str(tmp_path / "t")), True)
    first, again, lost = (writer.write(iter([(k, "v")])) for k in "abc")
    writer.commit([first, writer.write(iter([]))], 0)
    writer.commit([again], 0)
    writer.abort([lost], 1)
    assert reader.latestOffset() == {"w": 1}
    assert [row for p in reader.partitions({}, {"w": 1}) for row in reader.read(p)] == [("a", "v")]
    assert reader.partitions({"w": 1}, {"w": 1}) == []
