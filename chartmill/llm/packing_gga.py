"""Best-fit packing by a grouping genetic algorithm.

Texts become token ids with id 0 at their end; longer ones are cut into full pieces. Pieces are dealt
by hash into blocks of bounded size. Each block is packed by islands: separate tasks that breed
populations of packings, whose elites migrate to the next island of the ring through a shuffle between
epochs. A gene is a whole bin: crossover injects well-filled bins of one parent into the other, drops
the other's bins that now hold duplicates, and puts the displaced pieces back by best fit, longest
first. A block stops as soon as it reaches its lower bound.

Displaced pieces first replace smaller ones where that fills a bin better (dominance), so the breed gets past best fit
where best fit isn't optimal. In the end the emptiest bin of each block goes to a pool of POOL blocks, whose bins
are packed once more together: blocks don't each waste a part of a bin. Tasks hold one block or pool at a time;
nothing is collected.

Defined results: null and empty texts are one token (id 0); repeated doc_ids and rows are packed each;
null doc_ids are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import Encoder

#: Pieces in a block, islands of a block, epochs between migrations, offspring of an island in an epoch, packings it keeps.
BLOCK, ISLANDS, EPOCHS, OFFSPRING, POPULATION = 3000, 2, 2, 12, 4
#: Blocks whose emptiest bins are packed together.
POOL = 64


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, capacity: int, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, step = Encoder.of(path).encode, 4 * capacity
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = (encode(text) if isinstance(text, str) else b"") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], order: list[int], capacity: int, bins: list[list[int]], room: list[int]) -> None:
    """Puts the items of order into bins (extended in place) where they leave least room; room is kept by bin."""
    free = sorted((r, k) for k, r in enumerate(room) if r)
    for i in order:
        s = sizes[i]
        at = bisect_left(free, (s, -1))
        if at < len(free):
            r, k = free.pop(at)
            bins[k].append(i)
        else:
            r, k = capacity, len(bins)
            bins.append([i])
            room.append(capacity)
        room[k] = r - s
        if r > s:
            insort(free, (r - s, k))


def _fitness(room: list[int], capacity: int) -> tuple[int, float]:
    """Fewest bins first; among these, mean square fill, which favours full bins beside empty ones."""
    fill = 1 - np.asarray(room, dtype=float) / capacity
    return -len(room), float((fill * fill).mean())


def _packed(sizes: list[int], order: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    bins, room = [], []
    best_fit(sizes, order, capacity, bins, room)
    return bins, room


def _dominate(bins: list[list[int]], room: list[int], loose: list[int], sizes: list[int], order: list[int]) -> list[int]:
    """Swaps one or two items of a bin for one loose item, or for two, that fill it better; what is left loose is smaller and easier to place.

    loose is changed in step; bins are tried in the given order."""
    held = sorted((sizes[i], i) for i in loose)
    for k in order:
        if not held:
            break
        items, r = bins[k], room[k]
        if not r:
            continue
        choices = [(a,) for a in items] + [(a, b) for n, a in enumerate(items) for b in items[n + 1 :]]
        best = None
        for out in choices[:40]:
            freed = sum(sizes[i] for i in out)
            at = bisect_left(held, (freed + r + 1, -1)) - 1
            if at >= 0 and held[at][0] > freed and (best is None or held[at][0] - freed > best[0]):
                best = held[at][0] - freed, out, (at,)
            if len(out) == 1 and len(held) > 1:  # two loose items for one: the second fills what the first leaves
                first = bisect_left(held, (freed, -1)) - 1
                for x in (first, first // 2):
                    if x >= 0:
                        y = bisect_left(held, (freed + r - held[x][0] + 1, -1)) - 1
                        y -= y == x
                        if y >= 0 and (gain := held[x][0] + held[y][0] - freed) > 0 and (best is None or gain > best[0]):
                            best = gain, out, (x, y)
            if best and best[0] == r:
                break
        if best:
            gain, out, taken = best
            bins[k] = [i for i in items if i not in out] + [held[x][1] for x in taken]
            room[k] = r - gain
            for x in sorted(taken, reverse=True):
                held.pop(x)
            for i in out:
                insort(held, (sizes[i], i))
    return [i for _, i in held]


def _cross(a, b, sizes: list[int], capacity: int, rng: np.random.Generator):
    """Injects well-filled whole bins of b into a; a's bins with duplicates go, as do its emptiest; their other items replace smaller
    ones where they fill a bin better, and the rest are best-fitted, longest first."""
    (a_bins, a_room), (b_bins, b_room) = a, b
    full = np.argsort(np.asarray(b_room) + rng.random(len(b_room)) * capacity * 0.05, kind="stable")
    take = full[: max(1, int(len(full) * rng.uniform(0.1, 0.5)))].tolist()
    injected = {i for k in take for i in b_bins[k]}
    bins, room, displaced = [list(b_bins[k]) for k in take], [b_room[k] for k in take], []
    for items, r in zip(a_bins, a_room, strict=True):
        hit = [i for i in items if i not in injected]
        if len(hit) == len(items):
            bins.append(list(items))
            room.append(r)
        else:
            displaced += hit
    opened = set(sorted(range(len(room)), key=room.__getitem__, reverse=True)[: max(2, len(room) // 50)])
    for k in opened:
        displaced += bins[k]
    bins, room = [x for k, x in enumerate(bins) if k not in opened], [x for k, x in enumerate(room) if k not in opened]
    for _ in range(2):
        displaced = _dominate(bins, room, displaced, sizes, rng.permutation(len(bins)).tolist())
    displaced.sort(key=sizes.__getitem__, reverse=True)
    best_fit(sizes, displaced, capacity, bins, room)
    return bins, room


def lower_bound(sizes: list[int], capacity: int) -> int:
    return max(-(-sum(sizes) // capacity), sum(1 for s in sizes if 2 * s > capacity))


def evolve(sizes: list[int], capacity: int, seed: list[int], migrants: list[list[int]]) -> tuple[list[int], int]:
    """One island's epoch: the best assignment (item -> bin) found and its number of bins."""
    rng = np.random.Generator(np.random.Philox(key=[seed[0], (seed[1] << 8) + seed[2]]))
    least = lower_bound(sizes, capacity)
    people = []
    for m in migrants:
        bins: list[list[int]] = [[] for _ in range(max(m) + 1)] if m else []
        for i, k in enumerate(m):
            bins[k].append(i)
        people.append((bins, [capacity - sum(sizes[i] for i in x) for x in bins]))
    n = len(sizes)
    if not people:
        people.append(_packed(sizes, sorted(range(n), key=lambda i: -sizes[i]), capacity))
    while len(people) < POPULATION and len(people[0][1]) > least:
        noise = rng.uniform(0.7, 1.3, n)
        people.append(_packed(sizes, sorted(range(n), key=lambda i: -sizes[i] * noise[i]), capacity))
    people = sorted(((_fitness(p[1], capacity), p) for p in people), key=lambda x: x[0], reverse=True)
    for _ in range(OFFSPRING):
        if len(people[0][1][1]) <= least or len(people) < 2:
            break
        x, y = sorted(rng.choice(len(people), 2, replace=False).tolist())
        if rng.random() < 0.5:
            x, y = y, x
        child = _cross(people[x][1], people[y][1], sizes, capacity, rng)
        score = _fitness(child[1], capacity)
        if all(score != z[0] for z in people):  # no twins, so that the population keeps different bins
            people = sorted([*people, (score, child)], key=lambda z: z[0], reverse=True)[:POPULATION]
    bins = people[0][1][0]
    assigned = [0] * n
    for k, items in enumerate(bins):
        for i in items:
            assigned[i] = k
    return assigned, len(bins)


def pack_pieces(rows: DataFrame, capacity: int, seed: int = 0, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32) + sequence_id, offset."""
    blocks = max(1, -(-rows.count() // block))
    item = F.struct("doc_id", "piece", "ids_crc32", "start", "length")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("long"))
    table = written(dealt.groupBy("block").agg(F.sort_array(F.collect_list(item)).alias("items")), "pack-blocks")
    sizes = table.select("block", F.transform("items", lambda x: x["length"].cast("int")).alias("sizes"))
    state = sizes.select("block", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.array().cast("array<array<int>>").alias("migrants"))
    kind = "block long, island int, sizes array<int>, bins int, assigned array<int>"

    def epoch(k: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for b, island, size, migrants in zip(pdf["block"], pdf["island"], pdf["sizes"], pdf["migrants"], strict=True):
                    got, bins = evolve([int(x) for x in size], capacity, [seed, int(b) * islands + int(island), k], [[int(x) for x in m] for m in migrants])
                    yield pd.DataFrame({"block": [b], "island": [island], "sizes": [size], "bins": [bins], "assigned": [got]})

        return run

    for k in range(epochs):
        tasks = state.repartition("block", "island")
        done = written(tasks.mapInPandas(epoch(k), kind), f"pack-epoch{k}")
        if k + 1 < epochs:  # each island keeps its own elite and gets that of the island before it in the ring
            moved = done.select("block", ((F.col("island") + 1) % islands).alias("island"), "assigned").unionByName(done.select("block", "island", "assigned"))
            elite = moved.groupBy("block", "island").agg(F.collect_list("assigned").alias("migrants"))
            state = done.select("block", "island", "sizes").join(elite, ["block", "island"])
    best = sizes.join(done.groupBy("block").agg(F.min_by("assigned", F.struct("bins", "island")).alias("assigned")), "block")
    best = written(best, "pack-best")
    both = table.join(best.select("block", "sizes", "assigned").join(_pooled(best, capacity, seed), "block").mapInPandas(_places, "block long, at array<struct<sequence_id: long, offset: long>>"), "block")
    both = both.select(F.explode(F.arrays_zip("items", "at")).alias("x"))
    return both.select("x.items.doc_id", "x.items.piece", "x.items.start", "x.items.length", "x.items.ids_crc32", "x.at.sequence_id", "x.at.offset")


def _pooled(best: DataFrame, capacity: int, seed: int) -> DataFrame:
    """best (block, sizes, assigned) -> block, moved: (item, sequence_id) of each block's emptiest bin, packed anew with those of other blocks."""

    def emptiest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, size, assigned in zip(pdf["block"], pdf["sizes"], pdf["assigned"], strict=True):
                size, assigned = np.asarray(size, dtype=np.int64), np.asarray(assigned, dtype=np.int64)
                items = np.flatnonzero(assigned == np.bincount(assigned, weights=size).argmin())
                yield pd.DataFrame({"pool": [int(b) // POOL], "block": [b], "items": [items], "own": [size[items]]})

    def repack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        flat = [int(x) for own in pdf["own"] for x in own]
        pool = int(pdf["pool"].iloc[0])
        assigned, _ = evolve(flat, capacity, [seed, pool, 255], [])
        ends = np.cumsum([len(x) for x in pdf["own"]])
        moved = [[{"item": int(i), "sequence_id": -1 - ((pool << 24) + k)} for i, k in zip(items, assigned[e - len(items) : e], strict=True)] for items, e in zip(pdf["items"], ends, strict=True)]
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "moved": moved})

    loose = best.select("block", "sizes", "assigned").mapInPandas(emptiest, "pool long, block long, items array<long>, own array<long>")
    found = written(loose.groupBy("pool").applyInPandas(repack, "block long, moved array<struct<item: long, sequence_id: long>>"), "pack-pools")
    # a pool's sequence holds items of many blocks: their places follow one another in the order of blocks
    sized = found.select("block", F.posexplode("moved").alias("n", "m")).join(best.select("block", "sizes"), "block").select("block", "n", "m.item", "m.sequence_id", F.get("sizes", F.col("m.item").cast("int")).cast("long").alias("size"))
    upto = Window.partitionBy("sequence_id").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("offset", F.sum("size").over(upto) - F.col("size"))
    return placed.groupBy("block").agg(F.collect_list(F.struct("item", "sequence_id", "offset")).alias("moved"))


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """block, sizes, assigned, moved -> block, at: sequence and offset of every item of the block."""
    for pdf in batches:
        for b, size, assigned, moved in zip(pdf["block"], pdf["sizes"], pdf["assigned"], pdf["moved"], strict=True):
            size, assigned = np.asarray(size, dtype=np.int64), np.asarray(assigned, dtype=np.int64)
            order = np.argsort(assigned, kind="stable")
            before = np.cumsum(size[order]) - size[order]
            first = np.r_[True, assigned[order][1:] != assigned[order][:-1]]
            offset = np.empty(len(size), dtype=np.int64)
            offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
            at = [{"sequence_id": int(b) * (1 << 24) + int(k), "offset": int(o)} for k, o in zip(assigned, offset, strict=True)]
            for m in moved:
                at[m["item"]] = {"sequence_id": m["sequence_id"], "offset": m["offset"]}
            yield pd.DataFrame({"block": [b], "at": [at]})


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None, seed: int = 0) -> DataFrame:
    """docs (doc_id, text) -> one row a piece with its sequence and place there."""
    return pack_pieces(written(pieces(docs, capacity, path or tokenizer_path()), "pack-pieces"), capacity, seed)
