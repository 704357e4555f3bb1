"""A stream of references into a repository, with a restart."""

from pyspark.sql import functions as F

from tesselwork.sources.repository import Repository
from tesselwork.streaming import ingest

SCHEMA = "coord array<bigint>, location string, offset bigint, length bigint"


def test_each_batch_is_committed_once(spark, tmp_path):
    repo = Repository.create(spark, f"file://{tmp_path}/repo")
    s = repo.session()
    s.add_array("/a", [100], [1])
    s.commit("array")

    def put(start):
        spark.range(start, start + 5).select(F.array("id").alias("coord"), F.lit("s3://b/o").alias("location"), (F.col("id") * 10).alias("offset"), F.lit(10).cast("bigint").alias("length")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(checkpoint):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = ingest.stream_refs(stream, repo, "/a", "feed", f"{tmp_path}/{checkpoint}")
        q.awaitTermination()
        assert q.exception() is None

    put(0)
    put(5)
    run("one")
    commits = [x["metadata"].get("batch") for x in repo.ancestry()]
    assert commits[:2] == ["1", "0"] and repo.session(read_only=True).array_chunks("/a").count() == 10
    run("two")  # the same batches after the stream's own record was lost
    assert [x["metadata"].get("batch") for x in repo.ancestry()] == commits
    put(10)
    run("one")
    assert ingest.last_batch(repo, "feed", "main") == 2 and repo.session(read_only=True).array_chunks("/a").count() == 15
