"""N-gram Jaccard self-join by parity sketches.

A set's parity sketch XORs the hashes of its shingles into parts: a shingle in one set but not in the
other changes one part, so the number of parts that differ is at most the symmetric difference. Sets of
Jaccard similarity 3/4 or more differ in at most (|A| + |B|) / 7 shingles. Within a size band both sets
use the same parts, and each gives out its first d + 1 non-empty parts, d being the largest difference
that any partner in the band allows: at least one of these parts is equal in both (pigeonhole), so equal
parts find every pair. Sets with too few non-empty parts give out all, and their empty ones as well.

Very frequent shingles would make hot parts. A bounded sample names them (any choice is valid, as leaving
shingles out of both sets can only lower their difference); they are left out of the parts, and sets that
lack parts without them are joined once more with all their shingles.

Equal sets are one node. The nodes that gave out a part are a group; of groups with the same members one is kept.
Members of a group aren't paired with each other: in two rounds each node is tested against centres that its sketch
allows, links are contracted to components, and groups within one component are done. Members of groups that are
still of different components are compared in place, by size and by the Hamming distance of bit sketches; only pairs
that these allow are given out, each by the first group that holds both, so refused pairs never are rows. Every pair
is verified exactly, on 64-bit shingle hashes, and none that could link is left out.

Defined results: null, empty and wordless texts have n_shingles 0 and are components of their own;
null doc_ids get component null unless linked; repeated rows are equal sets; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, small_side, written
from .components import components
from .ngrams import mixed
from .shingles import set_key, sets

#: Bounded sample for frequent shingles: texts, times a shingle must be seen there, most kept.
SAMPLE_TEXTS, SAMPLE_TIMES, MOST_FREQUENT = 4000, 12, 50_000
#: Ids of texts to read again are broadcast up to this many (8 bytes each), else joined.
SMALL_IDS = 500_000
#: Rows of parts in a task, about: sets the number of partitions with the data.
PART_ROWS = 1_500_000
#: Rounds that test a node against centres before the members of still open groups are compared (links don't depend on it).
ROUNDS = 2
#: Centres of a node that a round compares by sketch, and those that it tests.
CENTRES, TESTED = 6, 2
#: Members of a group that a task compares with each other; a larger group is cut into pairs of blocks.
MOST_MEMBERS = 4000


def bands(n: int) -> list[tuple[int, int]]:
    """(band, largest difference to a partner there) of a set of n shingles."""
    m = n.bit_length() - 1
    out = [(m, (n + 4 * n // 3) // 7)]
    if m and n <= ((1 << m) - 1) * 4 // 3:  # partners of the band below, all of them smaller
        out.append((m - 1, (n + (1 << m) - 1) // 7))
    return [(b, d) for b, d in out if d >= 1]


def parts_in(band: int) -> int:
    return (1 << band) * 4 // 5 + 8


def _sketch_parts(s: np.ndarray, band: int, d: int, scheme: int) -> tuple[np.ndarray, bool]:
    """Keys of the parts that a set gives out in a band, and whether it lacks parts."""
    p = parts_in(band)
    part = ((mixed(s + np.uint64(band * 2 + 1)) >> np.uint64(32)) % np.uint64(p)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    sorted_part = part[order]
    first = np.flatnonzero(np.r_[True, sorted_part[1:] != sorted_part[:-1]]) if len(s) else np.zeros(0, dtype=np.int64)
    value = np.bitwise_xor.reduceat(s[order], first) if len(first) else np.zeros(0, dtype=np.uint64)
    index = sorted_part[first]
    lacks = len(first) < d + 1
    if lacks and scheme:
        empty = np.setdiff1d(np.arange(p), index)
        index, value = np.r_[index, empty], np.r_[value, np.zeros(len(empty), dtype=np.uint64)]
    elif not lacks:
        index, value = index[: d + 1], value[: d + 1]
    salt = np.uint64((scheme << 40) + (band << 32))
    return mixed(mixed(index.astype(np.uint64) + salt) ^ value), lacks


def _texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.large_binary()).to_pylist()


def _frequent(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the sample's most frequent shingles."""
    chosen = docs.where(F.col("text").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(31)), "doc_id").limit(SAMPLE_TEXTS)
    sample = docs.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi")  # at most SAMPLE_TEXTS ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, s in sets(_texts(b)):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["h"])

    counts = sample.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAMPLE_TIMES)
    rows = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").toPandas()["h"].to_numpy(dtype=np.int64)
    return np.sort(rows.view(np.uint64))


def _nodes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node, n, bits: the set's key (null without words), size and bit sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, bits = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64), [None] * len(b)
            for i, s in sets(_texts(b)):
                if len(s):
                    n[i], node[i], bits[i] = len(s), set_key(s), _bits(s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(node, mask=n == 0), pa.array(n), pa.array(bits, pa.binary())], ["doc_id", "text_key", "node", "n", "bits"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, node long, n long, bits binary")


def _given_out(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """sig, node: the parts that nodes give out. A task gives out a node once, however many copies it reads."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, done = sent.value, set()
        for b in batches:
            sigs, nodes, counts, total = [], [], [], 0
            for _, s in sets(_texts(b)):
                if not len(s) or (node := set_key(s)) in done:
                    continue
                done.add(node)
                rare = s
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    rare = s[hot[at] != s]
                for band, d in bands(len(s)):
                    keys, lacks = _sketch_parts(rare, band, d, 0)
                    if lacks:
                        keys = np.r_[keys, _sketch_parts(s, band, d, 1)[0]]
                    sigs.append(keys)
                    nodes.append(node)
                    counts.append(len(keys))
                    total += len(keys)
                if total > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(nodes, dtype=np.int64), counts))], ["sig", "node"])
                    sigs, nodes, counts, total = [], [], [], 0
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(nodes, dtype=np.int64), counts))], ["sig", "node"])

    return docs.select("text").mapInArrow(run, "sig long, node long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, node) -> sig, center, node for every other node of a part; holds one batch."""
    last_sig = last_center = last_node = None
    for b in batches:
        sig, node = b.column("sig").to_numpy(), b.column("node").to_numpy()
        if not len(sig):
            continue
        new = np.r_[last_sig is None or sig[0] != last_sig, sig[1:] != sig[:-1]]
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        center = np.empty(len(sig), dtype=np.int64)
        on = group >= 0
        center[on] = node[starts][group[on]] if len(starts) else 0
        center[~on] = last_center if last_center is not None else 0
        twin = np.r_[last_sig is not None and sig[0] == last_sig and node[0] == last_node, (sig[1:] == sig[:-1]) & (node[1:] == node[:-1])]
        keep = ~new & ~twin & (center != node)
        last_sig, last_center, last_node = sig[-1], center[-1], node[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(center[keep]), pa.array(node[keep])], ["sig", "center", "node"])


def _bits(s: np.ndarray) -> bytes:
    """Parity sketch of 2 to 4 bits a shingle: so many that sets a little beyond the bound already differ in more bits than linked ones can."""
    n = 1 << max(8, len(s).bit_length() + 1)
    bit = (mixed(s ^ np.uint64(0xA5A5A5A5)) % np.uint64(n)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=n) & 1).tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _read_again(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node, n, shingles of the nodes in ids (node, doc_id, text_key): one text of each is read; null doc_ids are matched too."""
    few = ids.limit(SMALL_IDS + 1).count() <= SMALL_IDS
    one = small_side(ids.select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), few)
    texts = docs.select("doc_id", "text").join(one, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))).select("text", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, keys, shingles = b.column("node").to_pylist(), [], []
            for i, s in sets(_texts(b)):
                if len(s) and set_key(s) == node[i]:
                    keys.append(node[i])
                    shingles.append(s.view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(s) for s in shingles], pa.int64()), pa.array(shingles, pa.list_(pa.int64()))], ["node", "n", "shingles"])

    return texts.mapInArrow(run, "node long, n long, shingles array<long>")


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, na, nb, bits_a, bits_b -> the pairs whose sketches differ no more than linked sets can."""
    for b in batches:
        n = b.column("na").to_numpy() + b.column("nb").to_numpy()
        keep = np.zeros(len(b), dtype=bool)
        for i, (x, y) in enumerate(zip(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist(), strict=True)):
            size = min(len(x), len(y))
            far = _folded(np.frombuffer(x, dtype=np.uint8), size) ^ _folded(np.frombuffer(y, dtype=np.uint8), size)
            keep[i] = int.from_bytes(far.tobytes(), "little").bit_count() <= n[i] // 7
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))


def _plausible(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that sizes and sketches (info: node, n, bits) allow."""
    a, b = info.toDF("a", "na", "bits_a"), info.toDF("b", "nb", "bits_b")
    near = pairs.join(a, "a").join(b, "b").where("4 * na >= 3 * nb AND 4 * nb >= 3 * na")
    return near.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_allowed, "a long, b long")


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, repeated: bool) -> DataFrame:
    """Of plausible pairs (a, b), those whose sets overlap enough: the sets of their nodes are made again and counted."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = nodes.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("x")).select("node", "x.doc_id", "x.text_key").join(wanted, "node", "left_semi")
    ids = written(ids, "parity-ids")
    with small_batches(docs.sparkSession):
        known = written(_read_again(docs, ids), "parity-sets")
    if repeated:  # some rows are identical
        known = known.dropDuplicates(["node"])
    a, b = known.toDF("a", "na", "sa"), known.toDF("b", "nb", "sb")
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= 75 * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _plausible_in(rows: list[dict]) -> Iterator[tuple[int, int]]:
    """(i, j) of a group's rows of different components that size and sketch allow. A row is compared with all later ones of its
    size at once; of a group's block pair, rows of one block meet in the pair of that block with itself."""
    rows.sort(key=lambda r: r["n"])
    label, n, block = (np.array([r[k] for r in rows], dtype=np.int64) for k in ("label", "n", "block"))
    apart = len(rows) > 0 and not rows[0]["own"]
    size = min(len(r["bits"]) for r in rows)
    wide = np.stack([_folded(np.frombuffer(r["bits"], dtype=np.uint8), size) for r in rows]).view(np.uint64)
    upto = np.searchsorted(n, 4 * n // 3, side="right")  # partners are at most a third larger
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, upto[i])
        j = j[(label[j] != label[i]) & ((block[j] != block[i]) if apart else True)]
        if len(j):
            far = np.bitwise_count(wide[j] ^ wide[i]).sum(1, dtype=np.int64)
            for k in j[far <= (n[i] + n[j]) // 7].tolist():
                yield i, k


def _groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows sorted by key, group by group."""
    held: list[dict] = []
    for b in batches:
        names = [c for c in b.schema.names if c != "sigs"]
        lists = b.column("sigs") if "sigs" in b.schema.names else None
        flat, at = (lists.values.to_numpy(), lists.offsets.to_pylist()) if lists is not None else (None, None)
        for i, values in enumerate(zip(*[b.column(c).to_pylist() for c in names], strict=True)):
            r = dict(zip(names, values, strict=True))
            if lists is not None:
                r["sigs"] = flat[at[i] : at[i + 1]]
            if held and held[-1]["key"] != r["key"]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _in_batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], names)
            held = []
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.int64()) for i in range(len(names))], names)


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """-> sig of groups that hold a plausible pair of different components."""
    return _in_batches(((g[0]["sig"],) for g in _groups_of(batches) if len(g) > 1 and next(_plausible_in(g), None)), ["sig"])


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """-> a, b: plausible pairs of different components, each from the first group that both are in (sigs: a node's groups)."""

    def pairs() -> Iterator[tuple[int, int]]:
        for g in _groups_of(batches):
            if len(g) > 1:
                found = list(_plausible_in(g))
                for i, j in found:
                    x, y = g[i]["sigs"], g[j]["sigs"]  # both sorted
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    if x[(y[at] == x).argmax()] == g[0]["sig"]:
                        yield g[i]["node"], g[j]["node"]

    return _in_batches(pairs(), ["a", "b"])


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """rows (sig, node ...) + key, block, own, sorted by key in a task. A group of over `most` rows is cut into blocks, and each pair of blocks is a key."""
    large = written(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most).select(F.col("sig").alias("s"), F.ceil(F.col("m") / most).cast("long").alias("blocks")), "parity-large")
    if not large.limit(1).count():
        keyed = rows.withColumns({"key": F.col("sig"), "block": F.lit(0).cast("long"), "own": F.lit(True)})
    else:
        cut = rows.join(large, F.col("sig") == F.col("s"), "left").drop("s").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        cut = cut.withColumn("block", F.pmod(F.xxhash64("node", F.lit(17)), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        key = F.xxhash64("sig", F.least("block", "other"), F.greatest("block", "other"))
        keyed = cut.withColumns({"key": F.when(F.col("blocks") > 1, key).otherwise(F.col("sig")), "own": F.col("block") == F.col("other")}).drop("blocks", "other")
    return keyed.repartition("key").sortWithinPartitions("key")


def _labelled(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """groups (sig, node) + label: the node's component so far, itself without links."""
    if labels is None:
        return groups.withColumn("label", F.col("node"))
    return groups.join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))


def _distinct_groups(groups: DataFrame) -> DataFrame:
    """One of the groups that have the same members: texts that share a passage share many parts. Member sets compare by 64-bit hash and size."""
    members = groups.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"))
    return groups.join(members.groupBy("m", "x").agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi")


def _open(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """The groups whose members are still of different components."""
    tagged = _labelled(groups, labels)
    mixed_ = tagged.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
    return groups.join(mixed_, "sig", "left_semi")


def _round_pairs(groups: DataFrame, labels: DataFrame | None, info: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) of a node with centres of its groups that are of another component: CENTRES are compared by sketch, and of
    those that it allows TESTED are kept.

    A group's centre is its member of most groups: the text that others were made from shares parts with all of them."""
    order = lambda c: F.xxhash64(F.lit(k), c)
    tagged = _labelled(groups, labels)
    wide = groups.groupBy("node").agg(F.count(F.lit(1)).alias("wide"))
    ranked = tagged.join(wide, "node")
    centres = ranked.groupBy("sig").agg(F.min(F.struct(-F.col("wide"), order(F.col("node")).alias("o"), F.col("node"), F.col("label"))).alias("c"))
    pairs = tagged.join(centres, "sig").where(F.col("label") != F.col("c.label")).groupBy("node", F.col("c.node").alias("a")).agg(F.count(F.lit(1)).alias("shared"))
    # parts that a pair shares speak for it, so the most come first
    first = Window.partitionBy("node").orderBy(F.desc("shared"), order(F.col("a")))
    some = pairs.withColumn("r", F.row_number().over(first)).where(F.col("r") <= CENTRES)
    near = _plausible(some.select("a", F.col("node").alias("b")), info)
    return near.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(order(F.col("a"))))).where(F.col("r") <= TESTED).select("a", "b")


def _last_pairs(groups: DataFrame, labels: DataFrame | None, info: DataFrame) -> DataFrame:
    """a, b: all pairs of different components that share a group and that size and sketch allow, each once.

    A long text's row holds kilobytes of sketch and of group keys, so Python gets few rows at once."""
    columns = ["key", "sig", "node", "label", "n", "bits", "block", "own"]
    with small_batches(groups.sparkSession, 500):
        rows = _labelled(groups, labels).join(info, "node")
        live = written(_dealt(rows, MOST_MEMBERS).select(columns).mapInArrow(_live, "sig long").distinct(), "parity-live")
        left = written(groups.join(live, "sig", "left_semi"), "parity-left")
        lists = left.groupBy("node").agg(F.sort_array(F.collect_list("sig")).alias("sigs"))  # at most the parts that a node gives out
        rows = _labelled(left, labels).join(info.join(lists, "node"), "node")
        return written(_dealt(rows, MOST_MEMBERS).select(*columns, "sigs").mapInArrow(_rest, "a long, b long"), "parity-rest")


def similar_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (doc_id, node, n by row; node, label of linked nodes)."""
    spark: SparkSession = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(spark):
        nodes = written(_nodes(d), "parity-nodes")
    words = nodes.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(words * 0.6 / PART_ROWS) + 1)
    with small_batches(spark, 3000):  # rows of parts go to Python in these batches too
        given = _given_out(d, _frequent(d)).repartition(tasks, "sig").sortWithinPartitions("sig", "node")
        stars = written(given.mapInArrow(_stars, "sig long, center long, node long"), "parity-stars")
    info = written(nodes.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("n").alias("n"), F.min("bits").alias("bits")), "parity-info")
    groups = written(_distinct_groups(stars.select("sig", "node").unionByName(stars.select("sig", F.col("center").alias("node")).distinct())), "parity-groups")
    repeated = bool(nodes.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count())
    labels = None
    for k in range(ROUNDS):
        with small_batches(spark):
            pairs = written(_round_pairs(groups, labels, info, k), "parity-pairs")
        if pairs.limit(1).count():
            labels = components(_linked(pairs, d, nodes, repeated), labels)
        groups = written(_open(groups, labels), "parity-open")
    rest = _last_pairs(groups, labels, info)
    if rest.limit(1).count():
        labels = components(_linked(rest, d, nodes, repeated), labels)
    if labels is None:
        labels = spark.createDataFrame([], "node long, label long")
    return nodes, labels


def _component_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n, label by row; label null without words."""
    nodes, labels = similar_components(docs)
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("doc_id", "text_key", "n", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id."""
    rows = _component_rows(docs)
    least = rows.where(F.col("label").isNotNull()).groupBy(F.col("label").alias("l")).agg(F.min("doc_id").alias("component"))
    out = rows.join(least, F.col("label") == F.col("l"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component the row with the least doc_id stays, one if it is repeated. Rows without words stay."""
    rows = written(_component_rows(docs), "parity-rows")
    first = rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select("x.*")
    kept = first.unionByName(rows.where(F.col("label").isNull()).select("doc_id", "text_key")).toDF("_id", "_key").distinct()
    out = docs.withColumn("_text_key", F.xxhash64("text")).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left_semi")
    if rows.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "_text_key"])
    return out.drop("_text_key")
