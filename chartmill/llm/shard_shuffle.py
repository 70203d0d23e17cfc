"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets that fit in memory, by a seeded hash of the record.
Pass two draws a Fisher-Yates permutation of each bucket. Buckets one after the other give every
record its place in one permutation of the whole table; place mod shards is the shard and place div
shards the slot, so shard sizes differ by at most one record (law ``rows``).

Equal texts are scattered apart like any others (a hash of doc_id and text deals them), and bucket
sizes are counted before places are given: no bucket grows with a group of copies. Rows that are identical in
every hashed column are counted map-side and told apart by their number.

Defined results: null texts have no bytes (crc32 of the empty string, size 1); null or repeated
doc_ids are records like any others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Records in a bucket, about, and bytes of a bucket that is written with its texts.
BUCKET_ROWS, BUCKET_BYTES = 20_000, 64_000_000


def _fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    order = list(range(n))
    swaps = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = swaps[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def two_pass_shuffle(records: DataFrame, key: list[str], seed: int = 0, bucket_rows: int = BUCKET_ROWS, n_rows: int | None = None) -> DataFrame:
    """records + ``place``: the row's place in one seeded permutation of the table. key: columns that fix a row's bucket and its order there."""
    n = records.count() if n_rows is None else n_rows
    buckets = max(1, -(-n // bucket_rows))
    if set(records.columns) == set(key):  # equal rows are alike in all: counted, then made again, a thousand at a time
        counted = records.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / 1000))))
        first = F.col("_block") * 1000 + 1
        numbered = counted.withColumn("_copy", F.explode(F.sequence(first, F.least(first + 999, F.col("_n"))))).drop("_n", "_block")
    else:
        numbered = records.withColumn("_copy", F.row_number().over(Window.partitionBy(*key).orderBy(*key)))
    dealt = numbered.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), *key, "_copy"), F.lit(buckets)).cast("long"))
    sizes = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(F.col("_bucket").alias("_b"), (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_start"))
    order = [*key, "_copy"]

    def permute(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [(c, "ascending") for c in order], null_placement="at_start"))
        rng = np.random.Generator(np.random.Philox(key=[seed, t.column("_bucket")[0].as_py()]))
        return t.append_column("_at", pa.array(_fisher_yates(len(t), rng)))

    schema = dealt.withColumn("_at", F.lit(0).cast("long")).schema
    shuffled = dealt.groupBy("_bucket").applyInArrow(permute, schema)
    # one row a bucket, so that records are not dealt again
    return shuffled.join(F.broadcast(starts), F.col("_bucket") == F.col("_b")).withColumn("place", F.col("_start") + F.col("_at")).drop("_bucket", "_b", "_at", "_start", "_copy")


def _bounded(docs: DataFrame, bucket_rows: int) -> tuple[int, int]:
    """Rows of docs, and rows of a bucket such that its texts stay under BUCKET_BYTES, about."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64), F.lit(0))).first()
    return n, max(1, min(bucket_rows, int(n * BUCKET_BYTES // max(size, 1))))


def shard(docs: DataFrame, shards: int = 16, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, shard, slot under the law ``rows``.

    Whole records pass both steps; sizes and checksums are those of the texts at their places."""
    n, bucket_rows = _bounded(docs, bucket_rows)
    placed = two_pass_shuffle(docs.select("doc_id", "text"), ["doc_id", "text"], seed, bucket_rows, n)
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return placed.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).cast("long").alias("text_crc32"), F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> None:
    """The whole records as Parquet, one folder a shard, in slot order."""
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    hashed = docs.withColumn("_crc", F.crc32(data).cast("long"))
    n, bucket_rows = _bounded(docs, bucket_rows)
    placed = two_pass_shuffle(hashed, ["doc_id", "_crc"], seed, bucket_rows, n).drop("_crc")
    placed = placed.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("place") / shards).cast("long")).drop("place")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
