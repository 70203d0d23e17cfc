"""Whole records, not their digests, pass the two steps of the shuffle; written shards hold them at the same places' law."""

from pyspark.sql import functions as F

from chartmill.llm import shard_shuffle


def test_records_pass_the_shuffle_whole(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i % 50, None if i % 17 == 0 else f"text {i % 23} " * (i % 9)) for i in range(300)], "doc_id long, text string")
    seen = []
    whole = shard_shuffle.two_pass_shuffle
    monkeypatch.setattr(shard_shuffle, "two_pass_shuffle", lambda records, *a, **k: seen.append(records.columns) or whole(records, *a, **k))
    got = shard_shuffle.shard(docs, 16, bucket_rows=40).collect()
    assert seen == [["doc_id", "text"]] and len(got) == 300
    assert sorted(r["shard"] + 16 * r["slot"] for r in got) == list(range(300))
    shard_shuffle.write_shards(docs, str(tmp_path / "shards"), 16, bucket_rows=40)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.select("doc_id", "text").exceptAll(docs).count() == 0 and back.agg(F.count_distinct("shard", "slot")).first()[0] == 300
