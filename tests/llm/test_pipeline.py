import corpus_pipeline as P


def test_stages_over_small_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0).unionByName(spark.read.parquet(f"{d}/documents.parquet"))
    before = {r["doc_id"]: r for r in docs.collect()}
    kept = P.quality_rules(spark, docs, d).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < len(before)
    one = P.near_duplicates(spark, kept, d).cache()
    assert one.count() <= kept.count()
    cut = P.repeated_passages(spark, one, d).cache()
    assert all(r["n_chars"] == len(r["text"]) <= before[r["doc_id"]]["n_chars"] for r in cut.collect())
    mixed = P.mixing(spark, cut, d).cache()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in cut.collect()}
    packed = P.packing(spark, mixed, d).collect()
    assert sum(r["piece"] == 0 for r in packed) == mixed.count()


def test_stages_take_an_empty_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, d)
    assert docs.count() == 0
