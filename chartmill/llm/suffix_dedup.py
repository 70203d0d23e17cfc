"""Repeated passages by a sparse, distributed suffix array.

A byte goes if it lies in a WINDOW-byte string that starts anywhere else too. Sorting a suffix for every
byte isn't needed for this: each window is represented by its least GRAM-byte hash (the leftmost), which
equal windows place alike, so only suffixes at these anchors are kept, one in some 180 bytes. A run is a
maximal row of windows with one anchor.

1. Runs that occur twice as a whole (hash of all their bytes) are repeated throughout: an aggregate.
2. Where runs around equal anchors differ, one suffix for each distinct run is range-partitioned by its
   leading bytes with splitters sampled from the data. Equal leading bytes stay in one bucket, so
   no match crosses a boundary. Buckets sort their suffixes by multikey quicksort on 8-byte tokens, and
   the bytes before the anchors likewise; common prefixes with neighbours bound which windows can match.
   Windows inside the bounds are then compared.
3. Spans are merged by row.

Passages can be counted in words as well: a text is then the row of its words' 32-bit hashes, four bytes a word, and the
same steps run over these bytes. A span of whole words comes out; white space between words doesn't count.

Anchors with more than HOT_RUNS distinct runs are compared by an aggregate over window hashes instead, so
no task holds such a group. Windows are compared by 64-bit hashes. Texts over SEGMENT bytes are cut into
overlapping segments for hashing, never for matching.

Defined results: null texts are empty (0 bytes, nothing removed, hash of no bytes); texts shorter than
WINDOW lose nothing; identical rows are occurrences of each other; null doc_ids are kept; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import made_so_far, release, written
from .shingles import substring_hashes

GRAM = 32
#: Bytes hashed at once, most bytes of a segment, distinct runs of an anchor that one bucket may hold.
GROUP_BYTES, SEGMENT, HOT_RUNS = 500_000, 8_000_000, 20_000
_PLACE = np.uint64((1 << 24) - 1)
#: Bytes of a word's hash where passages are counted in words; the contract's word in bytes.
WORD_BYTES, _WORD = 4, re.compile(rb"[^\x20\x09-\x0D]+")


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row."""
    n = len(key)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = key
    grid = full.reshape(blocks, width)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    onto = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onto[: n - width + 1], upto[width - 1 : n])


def _runs(parts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(part, first start, windows, anchor's place, anchor hash, run hash) of the runs of some byte strings, each `window` long at least."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(sizes)
    at = np.arange(len(data) - GRAM + 1)
    gram = substring_hashes(data, at, at + GRAM)
    least = _least((gram & ~_PLACE) | at.astype(np.uint64), window - GRAM + 1)
    part = np.repeat(np.arange(len(parts)), sizes)[: len(least)]
    good = np.arange(len(least)) + window <= ends[part]
    new = np.r_[True, least[1:] != least[:-1]] | np.r_[True, (part[1:] != part[:-1])]
    first = np.flatnonzero(new & good)
    stop = np.flatnonzero(good & np.r_[new[1:] | ~good[1:], True])
    place = (least[first] & _PLACE).astype(np.int64)
    begin = (ends - sizes)[part[first]]
    return part[first], first - begin, stop - first + 1, place - begin, gram[place], substring_hashes(data, first, stop + window)


def _word_codes(texts: list[bytes | None]) -> list[bytes]:
    """Texts as their words' hashes, WORD_BYTES a word."""
    out: list[bytes] = []
    group: list[list[bytes]] = []
    size = 0

    def flush():
        flat = [w for g in group for w in g]
        data = np.frombuffer(b" ".join(flat), dtype=np.uint8)
        end = np.cumsum(np.array([len(w) + 1 for w in flat], dtype=np.int64)) - 1
        start = np.r_[0, end[:-1] + 1] if len(flat) else end
        codes = (substring_hashes(data, start, end) >> np.uint64(32)).astype(np.uint32).tobytes()
        at = 0
        for g in group:
            out.append(codes[at : at + WORD_BYTES * len(g)])
            at += WORD_BYTES * len(g)
        group.clear()

    for t in texts:
        words = (t or b"").split()
        length = sum(map(len, words)) + len(words)
        if group and size + length > GROUP_BYTES:
            flush()
            size = 0
        group.append(words)
        size += length
    if group:
        flush()
    return out


def _word_rows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, k, text) with the text as its words' hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), pa.array(_word_codes(b.column("text").cast(pa.large_binary()).to_pylist()), pa.binary())], ["doc_id", "k", "text"])

    return docs.select("doc_id", "k", "text").mapInArrow(rows, "doc_id long, k long, text binary")


def _all_runs(docs: DataFrame, window: int, words: bool) -> DataFrame:
    """docs (doc_id, k, text) -> doc_id, k, p, n, anchor_at, anchor, run; of the texts' words if asked."""
    names = ["doc_id", "k", "p", "n", "anchor_at", "anchor", "run"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts, where):
            i, p, n, place, anchor, run = _runs(parts, window)
            w = np.array([x[2] for x in where], dtype=np.int64)
            ids, keys = pa.array([x[0] for x in where], pa.int64()), pa.array([x[1] for x in where], pa.int64())
            take = pa.array(i)
            return pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array(p + w[i]), pa.array(n), pa.array(place + w[i]), pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64))], names)

        for b in batches:
            parts, where, size = [], [], 0
            texts = b.column("text").cast(pa.large_binary()).to_pylist()
            for doc, k, t in zip(b.column("doc_id").to_pylist(), b.column("k").to_pylist(), _word_codes(texts) if words else texts, strict=True):
                t = t or b""
                for a in range(0, max(1, len(t) - window + 1), SEGMENT):
                    piece = t[a : a + SEGMENT + window - 1]
                    if len(piece) >= window:
                        if parts and size + len(piece) > GROUP_BYTES:
                            yield flush(parts, where)
                            parts, where, size = [], [], 0
                        parts.append(piece)
                        where.append((doc, k, a))
                        size += len(piece)
            if parts:
                yield flush(parts, where)

    return docs.select("doc_id", "k", "text").mapInArrow(rows, "doc_id long, k long, p long, n long, anchor_at long, anchor long, run long")


def _cut(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """wanted (doc_id, k, ...) + the run's bytes."""
    rows = wanted.groupBy("doc_id", "k").agg(F.collect_list(F.struct("anchor", "run", "c", "p", "n", "anchor_at")).alias("runs")).toDF("w_id", "w_k", "runs")
    both = docs.join(rows, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("k") == F.col("w_k"))).select("doc_id", "k", "text", "runs")
    kind = "doc_id long, k long, anchor long, run long, c long, p long, n long, anchor_at long, lead long, data binary"
    names = [x.split()[0] for x in kind.split(", ")]

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in names]
            done = set()
            for doc, k, t, runs in zip(b.column("doc_id").to_pylist(), b.column("k").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist(), b.column("runs").to_pylist(), strict=True):
                for r in runs:
                    if (doc, k, r["p"]) in done:  # identical rows
                        continue
                    done.add((doc, k, r["p"]))
                    lead = int.from_bytes(t[r["anchor_at"] : r["anchor_at"] + 8], "big") - (1 << 63)
                    for x, v in zip(out, (doc, k, r["anchor"], r["run"], r["c"], r["p"], r["n"], r["anchor_at"], lead, t[r["p"] : r["p"] + r["n"] - 1 + window]), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "data" else pa.int64()) for x, n in zip(out, names, strict=True)], names)

    return both.mapInArrow(slices, kind)


def _tokens(strings: list[bytes], width: int) -> np.ndarray:
    """Strings padded to `width` bytes, as big-endian 8-byte tokens: token order is byte order."""
    flat = b"".join([s[:width].ljust(width, b"\0") for s in strings])
    return np.frombuffer(flat, dtype=">u8").reshape(len(strings), width // 8).astype(np.uint64)


def multikey_quicksort(tokens: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of rows by (group, tokens): segments of equal leading tokens are partitioned by the next one until none is left."""
    order = np.argsort(group, kind="stable")
    seg = group[order]
    start = np.r_[True, seg[1:] != seg[:-1]] if len(seg) else np.zeros(0, dtype=bool)
    for level in range(tokens.shape[1]):
        number = np.cumsum(start) - 1
        size = np.bincount(number)
        live = np.flatnonzero(size[number] > 1)
        if not len(live):
            break
        rows = order[live]
        value = tokens[rows, level]
        by = np.lexsort((value, number[live]))
        order[live] = rows[by]
        value, owner = value[by], number[live][by]
        start[live] = np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]
    return order


def neighbour_prefix(tokens: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Longest common prefix in bytes of each row with any other row of its group: with one of its neighbours in sorted order."""
    order = multikey_quicksort(tokens, group)
    t, n, g = tokens[order], lengths[order], group[order]
    out = np.zeros(len(t), dtype=np.int64)
    if len(t) > 1:
        differ = t[1:] != t[:-1]
        word = np.where(differ.any(1), differ.argmax(1), t.shape[1])
        at = np.minimum(word, t.shape[1] - 1)
        x = t[1:][np.arange(len(at)), at] ^ t[:-1][np.arange(len(at)), at]
        zero = np.zeros(len(x), dtype=np.int64)
        for shift in range(56, -1, -8):
            zero += (zero == (56 - shift) // 8) & ((x >> np.uint64(shift)) & np.uint64(255) == 0)
        common = np.where(word < t.shape[1], 8 * word + np.minimum(zero, 8), 8 * t.shape[1])
        # padding is not text: a common prefix ends where the shorter string does
        common = np.where(g[1:] == g[:-1], np.minimum(common, np.minimum(n[1:], n[:-1])), 0)
        out[1:] = common
        out[:-1] = np.maximum(out[:-1], common)
    back = np.empty_like(out)
    back[order] = out
    return back


def _window_hashes(rows: list[tuple], low: np.ndarray, high: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset in the run, hash) of the windows low..high (inclusive) of each row's bytes, hashed GROUP_BYTES at a time."""
    size = np.array([len(r[-1]) for r in rows], dtype=np.int64)
    part = (np.cumsum(size) - size) // GROUP_BYTES
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(rows)]
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        data = np.frombuffer(b"".join([r[-1] for r in rows[a:b]]), dtype=np.uint8)
        begin = np.cumsum(size[a:b]) - size[a:b]
        n = np.maximum(high[a:b] - low[a:b] + 1, 0)
        row = np.repeat(np.arange(b - a), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[a:b], n)
        start = begin[row] + offset
        out.append(((row + a).astype(np.int32), offset.astype(np.int32), substring_hashes(data, start, start + window)))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def _compare(rows: list[tuple], window: int) -> Iterator[tuple]:
    """rows (doc_id, k, anchor, run, c, p, n, anchor_at, lead, data) of whole anchor groups -> (doc_id, k, start, end) of repeated spans of rows with c = 1."""
    anchor = np.array([r[2] for r in rows], dtype=np.int64)
    _, group, counts = np.unique(anchor, return_inverse=True, return_counts=True)
    keep = counts[group] > 1
    rows = [r for r, k in zip(rows, keep, strict=True) if k]
    group = group[keep]
    if not rows:
        return
    left = np.array([r[7] - r[5] for r in rows], dtype=np.int64)  # bytes of the run before its anchor
    n = np.array([r[6] for r in rows], dtype=np.int64)
    width = -(-window // 8) * 8
    right = [r[-1][a : a + window] for r, a in zip(rows, left.tolist(), strict=True)]
    ahead = neighbour_prefix(_tokens(right, width), np.array([len(x) for x in right]), group)
    before = [r[-1][:a][::-1] for r, a in zip(rows, left.tolist(), strict=True)]
    behind = neighbour_prefix(_tokens(before, width), left, group)
    # the window that starts l bytes before the anchor can match only if l <= behind and window - l <= ahead
    low, high = np.maximum(left - behind, 0), np.minimum(left - (window - ahead), n - 1)
    row, offset, h = _window_hashes(rows, low, high, window)
    order = np.lexsort((h, group[row]))
    g, x = group[row][order], h[order]
    same = (g[1:] == g[:-1]) & (x[1:] == x[:-1])
    twin = np.zeros(len(x), dtype=bool)
    twin[1:] |= same
    twin[:-1] |= same
    hit = np.sort(order[twin])
    r, o = row[hit], offset[hit]
    begin = np.r_[True, (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1)] if len(r) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(begin)
    last = np.r_[first[1:] - 1, len(r) - 1] if len(first) else first
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        x = rows[r[a]]
        if x[4] == 1:
            yield x[0], x[1], x[5] + int(o[a]), x[5] + int(o[b]) + window


def _buckets(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "k", "start", "end"]
        held: list[tuple] = []

        def out(rows):
            got = list(_compare(rows, window))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in range(4)], names)

        for b in batches:
            held += list(zip(*[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True))
            cut = len(held)
            while cut and held[cut - 1][2] == held[-1][2]:
                cut -= 1
            if cut > 2000:
                yield out(held[:cut])
                held = held[cut:]
        if held:
            yield out(held)

    return run


def _hot(rows: DataFrame, window: int) -> DataFrame:
    """Spans of hot anchors' rows: window hashes are counted by an aggregate; a window counts from its run's multiplicity."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rs = list(zip(*[part.column(i).to_pylist() for i in range(part.num_columns)], strict=True))
                if not rs:
                    continue
                n = np.array([r[6] for r in rs], dtype=np.int64)
                row, offset, h = _window_hashes(rs, np.zeros(len(rs), dtype=np.int64), n - 1, window)
                take = pa.array(row)
                cols = [pa.array([r[i] for r in rs], pa.int64()).take(take) for i in (0, 1, 2, 4, 5)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(offset, pa.int64()), pa.array(h.view(np.int64))], ["doc_id", "k", "anchor", "c", "p", "o", "h"])

    w = rows.mapInArrow(hashes, "doc_id long, k long, anchor long, c long, p long, o long, h long")
    often = w.groupBy(F.col("anchor").alias("a"), F.col("h").alias("h2")).agg(F.sum("c").alias("times")).where("times > 1")
    hit = w.where("c = 1").join(often, (F.col("anchor") == F.col("a")) & (F.col("h") == F.col("h2")), "left_semi")
    return hit.select("doc_id", "k", (F.col("p") + F.col("o")).alias("start"), (F.col("p") + F.col("o") + window).alias("end"))


def repeated_spans(docs: DataFrame, window: int = 400, words: bool = False) -> DataFrame:
    """docs (doc_id, k, text) -> doc_id, k, spans (array of start, end in bytes; unmerged) of rows that have any, as a written table.

    words: bytes are those of the words' hashes."""
    spark = docs.sparkSession
    before = set(made_so_far())
    runs = written(_all_runs(docs, window, words), "suffix-runs")
    docs = _word_rows(docs) if words else docs
    kinds = written(runs.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "k", "p", "n", "anchor_at")).alias("r")), "suffix-kinds")
    whole = kinds.where("c > 1").select(F.col("anchor").alias("a"), F.col("run").alias("r2"))
    full = runs.join(whole, (F.col("anchor") == F.col("a")) & (F.col("run") == F.col("r2")), "left_semi").select("doc_id", "k", F.col("p").alias("start"), (F.col("p") + F.col("n") - 1 + window).alias("end"))
    groups = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("least")).where("m > 1 and least = 1").select(F.col("anchor").alias("a"), "m")
    mixed_runs = kinds.join(groups, F.col("anchor") == F.col("a")).select("r.*", "anchor", "run", "c", "m")
    wanted = written(mixed_runs, "suffix-wanted")
    cut = _cut(docs, wanted.where(F.col("m") <= HOT_RUNS).select("doc_id", "k", "anchor", "run", "c", "p", "n", "anchor_at"), window)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted.count() // 20_000 + 1)
    sorted_ = cut.repartitionByRange(tasks, "lead", "anchor").sortWithinPartitions("lead", "anchor")
    found = sorted_.mapInArrow(_buckets(window), "doc_id long, k long, start long, end long").unionByName(full)
    if wanted.where(F.col("m") > HOT_RUNS).limit(1).count():
        found = found.unionByName(_hot(_cut(docs, wanted.where(F.col("m") > HOT_RUNS).drop("m"), window), window))
    steps = [p for p in made_so_far() if p not in before]
    del runs, kinds, whole, groups, mixed_runs, cut, sorted_
    spans = written(found.groupBy("doc_id", "k").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "suffix-spans")
    del found, full, wanted
    release(spark, steps, None)
    return spans


def repeated_words(docs: DataFrame, words: int) -> DataFrame:
    """As repeated_spans, in words: spans that rows of `words` words cover which start anywhere else too."""
    spans = repeated_spans(docs, words * WORD_BYTES, True)
    whole = F.transform("spans", lambda s: F.struct(F.ceil(s["start"] / WORD_BYTES).alias("start"), F.floor(s["end"] / WORD_BYTES).alias("end")))
    return spans.select("doc_id", "k", F.filter(whole, lambda s: s["end"] - s["start"] >= words).alias("spans"))




def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs + _k, and their (doc_id, k, text)."""
    keyed = docs.withColumn("_k", F.xxhash64("doc_id", "text"))
    return keyed, keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_k").alias("k"), "text")


def _with(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """keyed docs + the columns of spans (doc_id, k, ...)."""
    other = spans.withColumnsRenamed({"doc_id": "_id", "k": "_k2"})
    return keyed.join(other, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_k2")), "left").drop("_k", "_id", "_k2")


def digest(docs: DataFrame, window: int = 400, words: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `words` also n_passage_words: the words in
    passages of that many words or more that occur elsewhere too. Nothing is removed for these."""
    keyed, rows = _keyed(docs.select("doc_id", "text"))
    spans = repeated_spans(rows, window).withColumnRenamed("spans", "_spans")
    if words:
        said = repeated_words(rows, words).toDF("c", "d", "_passages")
        both = spans.toDF("a", "b", "_spans").join(said, F.col("a").eqNullSafe(F.col("c")) & (F.col("b") == F.col("d")), "full")
        spans = both.select(F.coalesce("a", "c").alias("doc_id"), F.coalesce("b", "d").alias("k"), "_spans", "_passages")
    else:
        spans = spans.withColumn("_passages", F.lit(None).cast("array<struct<start:long,end:long>>"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in names[1:]]
            for value, spans, passages in zip(b.column("text").cast(pa.large_binary()), b.column("_spans").to_pylist(), b.column("_passages").to_pylist(), strict=True):
                t = value.as_py() or b""
                gone, said = (merged([(s["start"], s["end"]) for s in x or []]) for x in (spans, passages))
                for x, v in zip(out, (len(t), sum(e - a for a, e in gone), len(gone), hashlib.sha256(_kept(t, gone)).hexdigest(), sum(e - a for a, e in said)), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(x, pa.string() if n == "kept_sha256" else pa.int64()) for n, x in zip(names[1:], out, strict=True)]], names)

    found = _with(keyed, spans).select("doc_id", "text", "_spans", "_passages").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")
    return found if words else found.drop("n_passage_words")


def _in_bytes(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes, from a first word's start to a last word's end."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def without_repeats(docs: DataFrame, window: int = 400, unit: str = "bytes") -> DataFrame:
    """docs with repeated passages of `window` bytes or words cut out of text (bytes of characters cut in two go too); rows that lose everything go."""
    keyed, plain = _keyed(docs)
    rows = _with(keyed, (repeated_words if unit == "words" else repeated_spans)(plain, window).withColumnRenamed("spans", "_spans"))
    columns = list(docs.columns)
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, texts = [], []
            for value, spans in zip(b.column("text").cast(pa.large_binary()), b.column("_spans").to_pylist(), strict=True):
                t = value.as_py()
                if spans:
                    gone = merged([(s["start"], s["end"]) for s in spans])
                    t = _kept(t, _in_bytes(t, gone) if unit == "words" else gone)
                    kept.append(bool(t.strip()))
                    texts.append(t.decode("utf-8", "ignore"))
                else:
                    kept.append(True)
                    texts.append(None if t is None else t.decode())
            cols = [pa.array(texts, pa.string()) if i == at else b.column(c) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(cols, columns).filter(pa.array(kept))

    return rows.select(*columns, "_spans").mapInArrow(run, docs.schema)


__all__ = ["GRAM", "digest", "merged", "multikey_quicksort", "neighbour_prefix", "repeated_spans", "repeated_words", "without_repeats"]
