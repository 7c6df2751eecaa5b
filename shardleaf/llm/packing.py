"""Filling containers of fixed capacity by a grouping genetic algorithm on migrating islands."""

from bisect import bisect_left, insort
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "shard int, island int, rows array<bigint>, sizes array<int>, pop array<array<int>>"


class Packing:
    """Bins of item numbers and their loads."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.loads = bins, [sum(sizes[i] for i in b) for b in bins]
        self.fitness = sum((load / capacity) ** 2 for load in self.loads) / max(1, len(bins))  # few full bins beat many half full ones


def _best_fit(bins: list[list[int]], items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Each of ``items``, in the given order, put into the bin that it fills best, or into a new one."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, k = room.pop(at)
        else:
            free, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        insort(room, (free - sizes[i], k))
    return bins


def _exchange(bins: list[list[int]], free: list[int], sizes: list[int], capacity: int, rng: Random) -> list[int]:
    """Displaced items against those in bins, wherever a bin is filled better: up to two of a bin against one or two.

    Gives back what is displaced afterwards, large ones first; a bin never gets emptier.
    """
    pool = sorted((sizes[i], i) for i in free)
    for k in rng.sample(range(len(bins)), len(bins)):
        b = bins[k]
        gap = capacity - sum(sizes[i] for i in b)
        if gap <= 0 or not pool:
            continue
        few = b[:6]
        outs = [(0, ()), *((sizes[i], (i,)) for i in b), *((sizes[i] + sizes[j], (i, j)) for x, i in enumerate(few) for j in few[:x])]
        most, move = 0, None
        for size, out in outs:
            low, high = 0, bisect_left(pool, (size + gap + 1, -1)) - 1
            if high >= 0 and pool[high][0] - size > most:
                most, move = pool[high][0] - size, (out, (high,))
            while low < high and most < gap:
                both = pool[low][0] + pool[high][0] - size
                if both > gap:
                    high -= 1
                    continue
                if both > most:
                    most, move = both, (out, (high, low))
                low += 1
            if most == gap:
                break
        if move:
            out, places = move
            new = [pool.pop(at)[1] for at in places]  # the later place first
            for i in out:
                b.remove(i)
                insort(pool, (sizes[i], i))
            b.extend(new)
    return [i for _, i in reversed(pool)]


def _settle(kept: list[list[int]], free: list[int], sizes: list[int], capacity: int, rng: Random, poor: int) -> Packing:
    """Bins and displaced items as a whole packing: the poorest bins and a few of the poorer half dissolve as well, then items are exchanged, and what is left goes where it fits best."""
    order = sorted(range(len(kept)), key=lambda k: sum(sizes[i] for i in kept[k]))
    gone = {*order[:poor], *rng.sample(order[: len(order) // 2], min(poor, len(order) // 2))}
    bins = [list(b) for k, b in enumerate(kept) if k not in gone]
    left = _exchange(bins, free + [i for k in sorted(gone) for i in kept[k]], sizes, capacity, rng)
    return Packing(_best_fit(bins, left, sizes, capacity), sizes, capacity)


def _cross(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: Random, poor: int) -> Packing:
    """Well-filled bins of b go whole into a; a's bins that share items with them dissolve, and their other items are displaced."""
    part = rng.sample(range(len(b.bins)), max(1, len(b.bins) // 6))
    taken = [b.bins[k] for k in sorted(part, key=lambda k: -b.loads[k])[: max(1, len(part) // 2)]]
    inside = {i for x in taken for i in x}
    kept = [x for x in a.bins if inside.isdisjoint(x)]
    free = [i for x in a.bins if not inside.isdisjoint(x) for i in x if i not in inside]
    return _settle([*taken, *kept], free, sizes, capacity, rng, poor)


def _encode(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _decode(bin_of) -> list[list[int]]:
    bins = [[] for _ in range(max(bin_of) + 1)]
    for i, k in enumerate(bin_of):
        bins[k].append(i)
    return [b for b in bins if b]


def evolve(sizes: list[int], pop: list[list[list[int]]], capacity: int, population: int, generations: int, rng: Random, poor: int = 3) -> list[Packing]:
    """The population after so many generations, best first. A short one is filled up with noisy best-fit packings.

    Every other generation is a mutation: the poorest bins of one packing dissolve and are settled anew.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    least = -(-sum(sizes) // capacity)
    found = [Packing(x, sizes, capacity) for x in pop]
    while len(found) < population:
        noise = capacity // (4 << len(found) % 3) if found else 0  # the first is plain best fit, large ones first
        found.append(Packing(_best_fit([], sorted(order, key=lambda i: -sizes[i] + rng.uniform(-noise, noise)), sizes, capacity), sizes, capacity))
    found.sort(key=lambda x: -x.fitness)
    for g in range(generations):
        if len(found[0].bins) <= least:
            break
        a, b = rng.sample(range(len(found)), 2)
        found.append(_settle(found[a].bins, [], sizes, capacity, rng, poor + 1) if g % 2 else _cross(found[a], found[b], sizes, capacity, rng, poor))
        found.sort(key=lambda x: -x.fitness)
        found = found[:population]
    return found


def _pack(items: DataFrame, capacity: int, shard_items: int, islands: int, population: int, generations: int, epochs: int) -> DataFrame:
    """``row, size`` (size within capacity) to ``shard, rows, sizes, bins``: the best packing of each shard.

    A row's shard follows from its number, so that shards are of about ``shard_items`` items whatever the data.
    """
    shards = max(1, round(items.count() / shard_items))
    # The partitions are counted by work, as the few bytes of a shard say nothing of the time that it takes.
    tasks = -(-shards * islands // 8)
    given = items.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).repartition(tasks, "shard").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("row", "size"))).alias("x"))
    state = given.select("shard", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), F.col("x.row").alias("rows"), F.col("x.size").alias("sizes"), F.array().cast("array<array<int>>").alias("pop"))

    def epoch(number: int):
        def run(batches):
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    sizes = [int(s) for s in r.sizes]
                    pop = evolve(sizes, [_decode(x) for x in r.pop], capacity, population, generations, Random(f"{r.shard}/{r.island}/{number}"))
                    codes = [_encode(x.bins, len(sizes)) for x in pop]
                    out.append((r.shard, r.island, r.rows, r.sizes, codes))
                    if islands > 1:
                        out.append((r.shard, (r.island + 1) % islands, r.rows[:0], r.sizes[:0], codes[:1]))
                yield pd.DataFrame(out, columns=["shard", "island", "rows", "sizes", "pop"])

        return run

    for number in range(epochs):
        # Each island's own row carries the items; the row from its neighbour carries only an elite packing.
        state = state.mapInPandas(epoch(number), STATE).repartition(tasks, "shard", "island").groupBy("shard", "island").agg(F.flatten(F.collect_list("rows")).alias("rows"), F.flatten(F.collect_list("sizes")).alias("sizes"), F.flatten(F.collect_list("pop")).alias("pop"))

    def best(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                sizes = [int(s) for s in r.sizes]
                best = max((Packing(_decode(x), sizes, capacity) for x in r.pop), key=lambda x: x.fitness)
                out.append((r.shard, r.island, r.rows, r.sizes, _encode(best.bins, len(sizes)), best.fitness))
            yield pd.DataFrame(out, columns=["shard", "island", "rows", "sizes", "bins", "fit"])

    found = state.mapInPandas(best, "shard int, island int, rows array<bigint>, sizes array<int>, bins array<int>, fit double")
    return found.groupBy("shard").agg(F.max_by(F.struct("rows", "sizes", "bins"), F.struct("fit", "island")).alias("b")).select("shard", "b.*")


def pack(df: DataFrame, id_col: str, size: "F.Column", capacity: int = 4096, shard_items: int = 1000, islands: int = 2, population: int = 4, generations: int = 20, epochs: int = 2, repack_below: float = 0.99) -> DataFrame:
    """Every row of ``df`` assigned to containers of ``capacity``: ``id_col, piece_no, n_pieces, start, length, container``.

    ``size`` is a column expression, a count of 1 at least (null or less counts as 1). Only a row larger than the
    capacity is divided: into full pieces, which are containers of their own, and the rest, which is packed like a
    whole row. Ties, repeated rows and repeated or null ids are packed row by row; an empty table gives an empty
    result; other columns are ignored, whatever their names.

    Rows are packed in shards of about ``shard_items``. Each shard has ``islands`` populations that evolve
    by themselves for ``generations`` and then send their best packing on, ``epochs`` times. Containers filled
    to less than ``repack_below`` are dissolved and packed once more, now among those of other shards. Only row
    numbers and sizes are shuffled, never the texts.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)).cast("int").alias("_size")).withColumn("_row", F.monotonically_increasing_id())
    full, rest = F.floor(F.col("_size") / capacity).cast("int"), F.col("_size") % capacity
    rows = rows.withColumn("_full", full).withColumn("_rest", rest.cast("int")).checkpoint()  # row numbers are fixed from here on
    rest = rows.where(F.col("_rest") > 0).select(F.col("_row").alias("row"), F.col("_rest").alias("size"))

    packed = _pack(rest, capacity, shard_items, islands, population, generations, epochs).checkpoint()
    placed = packed.select("shard", F.explode(F.arrays_zip("rows", "sizes", "bins")).alias("x")).select(F.col("x.rows").alias("row"), F.col("x.sizes").alias("size"), F.concat_ws("-", F.lit("a"), "shard", F.col("x.bins")).alias("container"), F.struct("shard", "x.bins").alias("_bin"))
    fill = packed.select("shard", F.explode(F.arrays_zip("sizes", "bins")).alias("x")).groupBy(F.struct("shard", "x.bins").alias("_bin")).agg(F.sum("x.sizes").alias("_fill"))
    placed = placed.join(fill, "_bin")
    loose = placed.where(F.col("_fill") < repack_below * capacity).select("row", "size").checkpoint()
    again = _pack(loose, capacity, shard_items, islands, population, generations, epochs)
    again = again.select("shard", F.explode(F.arrays_zip("rows", "bins")).alias("x")).select(F.col("x.rows").alias("row"), F.concat_ws("-", F.lit("b"), "shard", F.col("x.bins")).alias("container"))
    final = placed.where(F.col("_fill") >= repack_below * capacity).select("row", "container").unionByName(again)

    n_pieces = F.col("_full") + (F.col("_rest") > 0).cast("int")
    start = F.col("_full") * capacity
    last = rows.where(F.col("_rest") > 0).join(final.withColumnRenamed("row", "_row"), "_row").select("_id", (F.col("_full") + 1).alias("piece_no"), n_pieces.alias("n_pieces"), start.alias("start"), F.col("_rest").alias("length"), "container")
    whole = rows.where(F.col("_full") > 0).select("_id", "_row", n_pieces.alias("n_pieces"), F.explode(F.sequence(F.lit(1), F.col("_full"))).alias("piece_no"))
    whole = whole.select("_id", "piece_no", "n_pieces", ((F.col("piece_no") - 1) * capacity).alias("start"), F.lit(capacity).alias("length"), F.concat_ws("-", F.lit("full"), "_row", "piece_no").alias("container"))
    return last.unionByName(whole).withColumnRenamed("_id", id_col)


def byte_tokens(text_col: str):
    """Tokens of a byte-level tokenizer without merges: one per UTF-8 byte and one to end the text."""
    return F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 1
