"""The k most similar vectors of every vector, from neighbouring keys in several shifted Hilbert orderings."""

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of the rows of ``cells`` (n x m, integers below 2**bits) along the Hilbert curve (Skilling 2004), as rows of bytes, most significant first."""
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            inside = (x[i] & top) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    return np.packbits(np.stack([(row >> level) & 1 for level in range(bits - 1, -1, -1) for row in x], axis=1).astype(np.uint8), axis=1)


@dataclass(frozen=True)
class Axes:
    """The directions along which the vectors of one width spread most, their middle and their spread."""

    middle: np.ndarray
    directions: np.ndarray
    spread: float


def fit_axes(vectors: np.ndarray, most: int) -> Axes:
    """Principal axes of a sample; with few vectors the axes of the space stand in."""
    dims = vectors.shape[1]
    middle = vectors.mean(axis=0)
    if len(vectors) < 4 * most:
        return Axes(middle * 0, np.eye(dims)[:, :most], dims**-0.5)
    _, _, axes = np.linalg.svd(vectors - middle, full_matrices=False)
    return Axes(middle, axes[:most].T, max(1e-6, float(((vectors - middle) @ axes[:most].T).std(axis=0).mean())))


def _ordering(number: int, fitted: Axes, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """The turned projection and the shift of an ordering; they follow from its number and the axes, so all tasks agree."""
    rng = np.random.default_rng([number, *fitted.directions.shape])
    turn, _ = np.linalg.qr(rng.standard_normal((fitted.directions.shape[1],) * 2))
    return fitted.directions @ turn[:, :axes] / (6 * fitted.spread), rng.uniform(-1 / 12, 1 / 12, min(axes, turn.shape[1]))


def _near(vectors: np.ndarray, ids: np.ndarray, first: int, last: int, window: int, k: int, block: int = 512, spare: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For rows first to last: the places and cosines of the k most similar rows, ties by id; minus infinity where there are fewer.

    Rows are compared in blocks, each with all rows of its block and at least ``window`` rows on either side, in single
    precision; the best and a few to spare are then measured in double precision, in which sums of products of halves
    are exact, so a pair has the same cosine wherever it is met.
    """
    n = len(vectors)
    exact = vectors.astype(np.float64)
    exact /= np.sqrt((exact**2).sum(1))[:, None]
    quick, by_id = exact.astype(np.float32), np.empty(n)
    by_id[np.argsort(ids, kind="stable")] = np.arange(n)
    places, cosines = np.zeros((last - first, k), int), np.full((last - first, k), -np.inf)
    for at in range(first, last, block):
        end = min(last, at + block)
        a, b = max(0, at - window), min(n, end + window)
        rough = quick[at:end] @ quick[a:b].T
        rough[np.arange(end - at), np.arange(at, end) - a] = -np.inf
        held, most = min(k + spare, b - a), min(k, b - a)
        best = np.argpartition(rough, b - a - held, axis=1)[:, b - a - held :] + a
        loss = -np.rint(np.einsum("id,ijd->ij", exact[at:end], exact[best]) * 1e6)
        loss[best == np.arange(at, end)[:, None]] = np.inf
        best, loss = (np.take_along_axis(x, np.lexsort((by_id[best], loss), axis=1)[:, :most], 1) for x in (best, loss))
        places[at - first : end - first, :most] = best
        cosines[at - first : end - first, :most] = -loss / 1e6
    return places, cosines


def similar_vectors(df: DataFrame, id_col: str, group_col: str, vector_col: str, k: int = 5, orderings: int = 8, window: int = 1024, axes: int = 8, spread_axes: int = 16, bits: int = 15, sample: int = 4096, task_rows: int = 20_000) -> DataFrame:
    """``id_col, neighbour, similarity, rank``: the k vectors of the same group most similar (cosine) to each vector.

    Vectors are usable if they are not null, hold no null, NaN or infinity, and are not all zeros; others have no row
    and are no neighbour. Vectors of different width are never compared; a null group is a group of its own. Ids should
    be unique: rows that repeat id, group and vector count once. Equal similarities rank by id. A vector without
    another one in its group has no row. Other columns are ignored, whatever their names.

    Vectors travel in half precision, so cosines are right to about 0.0005; those equal in it are one vector: the
    smallest id stands for its copies in all orderings, and the copies come back, by id, before neighbours are chosen.
    Of each width, ``spread_axes`` principal axes are fitted on at most ``sample`` vectors, those first by a hash. Every
    vector is projected on ``axes`` random directions among them, shifted and given its place on a Hilbert curve of so
    many ``bits`` that a crowd of very similar vectors is still spread along it, once per ordering. Each ordering is
    range-partitioned and sorted by place; a vector is compared with at least ``window`` rows before and after it, in
    large tables with four times the square root of their vectors. The results of all orderings merge. What is lost:
    neighbours that no ordering brings within the window, or that a border between tasks parts in each of them.
    """
    value = F.col(vector_col).cast("array<float>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.coalesce(F.exists(value, bad), F.lit(True)) & F.coalesce(F.exists(value, lambda x: x != 0), F.lit(False))
    given = df.where(usable).select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("grp"), value.alias("v"))
    kind = given.schema["id"].dataType
    half_fields = [T.StructField("id", kind), T.StructField("grp", T.StringType()), T.StructField("dims", T.IntegerType()), T.StructField("vec", T.BinaryType())]
    keyed_schema = T.StructType([*half_fields, T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.BinaryType()))])

    def halve(batches):
        for pdf in batches:
            for dims, part in pdf.groupby(pdf["v"].map(len), sort=False):
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                half = x.astype(np.float16) + np.float16(0)  # no negative zeros
                yield pd.DataFrame({"id": part["id"], "grp": part["grp"], "dims": dims, "vec": [r.tobytes() for r in half]})

    def place(batches):
        fitted = shared.value
        for pdf in batches:
            for dims, part in pdf.groupby("dims", sort=False):
                x = np.frombuffer(b"".join(part["vec"]), np.float16).reshape(-1, dims).astype(np.float64)
                keys = []
                for number in range(orderings):
                    projection, shift = _ordering(number, fitted[dims], axes)
                    unit = np.clip((x - fitted[dims].middle) @ projection + shift + 0.5, 0, 1 - 1e-9)
                    keys.append([r.tobytes() for r in hilbert_keys((unit * (1 << bits)).astype(np.int64), bits)])
                yield part.assign(keys=list(zip(*keys)))

    rows = given.mapInPandas(halve, T.StructType(half_fields)).distinct().checkpoint()
    alike = rows.groupBy("grp", "dims", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "grp", "dims", "vec", "n")
    sizes = {r.dims: r.n for r in alike.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each width
    share = F.lit(0.0)
    for dims, n in sizes.items():
        share = F.when(F.col("dims") == dims, min(1.0, 1.2 * sample / n)).otherwise(share)
    few = alike.select("dims", "vec", F.xxhash64("vec").alias("hash")).where(F.pmod("hash", F.lit(1 << 20)) <= share * (1 << 20))
    few = few.withColumn("at", F.row_number().over(Window.partitionBy("dims").orderBy("hash", "vec"))).where(F.col("at") <= sample)
    drawn: dict[int, list] = {}
    for r in few.select("dims", "vec").collect():
        drawn.setdefault(r.dims, []).append(np.frombuffer(r.vec, np.float16).astype(np.float64))
    shared = df.sparkSession.sparkContext.broadcast({dims: fit_axes(np.stack(x), min(spread_axes, dims)) for dims, x in drawn.items()})
    # Written once: the range partitioning looks at the keys before it moves them.
    keyed = alike.mapInPandas(place, keyed_schema).checkpoint()
    vectors = keyed.count()
    window = max(window, 4 * isqrt(vectors))
    tasks = max(1, -(-vectors * orderings // max(task_rows, 40 * window)))
    line = keyed.select("id", "grp", "dims", "vec", F.posexplode("keys").alias("ordering", "key"))
    order = ["ordering", "grp", "dims", "key", "id"]
    line = line.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    near_schema = T.StructType([T.StructField("id", kind), T.StructField("losses", T.ArrayType(T.FloatType())), T.StructField("near", T.ArrayType(kind))])

    def compare(batches):
        held, begun = None, 0  # rows kept back, and how many of them are already answered
        for pdf in _runs(batches):
            if pdf is None:  # the run ends
                if held is not None:
                    yield _answers(held, begun, len(held), window, k)
                held, begun = None, 0
                continue
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            ready = len(held) - window
            if ready - begun >= 4096:
                yield _answers(held, begun, ready, window, k)
                drop = max(0, ready - window)
                held, begun = held.iloc[drop:].reset_index(drop=True), ready - drop

    found = line.mapInPandas(compare, near_schema)
    near = F.transform(F.arrays_zip("losses", "near"), lambda x: F.struct(x["losses"].cast("double").alias("loss"), x["near"].alias("id")))
    merged = found.groupBy("id").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(near)))), 1, k).alias("near"))

    # Copies come back: k of them and one more, as a row is none of its own neighbours.
    many = keyed.where("n > 1").select(F.col("id").alias("one"), F.col("grp").alias("_g"), F.col("dims").alias("_d"), F.col("vec").alias("_v"))
    copies = rows.join(many, rows["grp"].eqNullSafe(many["_g"]) & (rows["dims"] == many["_d"]) & (rows["vec"] == many["_v"])).select("one", "id")
    first = copies.withColumn("_n", F.row_number().over(Window.partitionBy("one").orderBy("id"))).where(F.col("_n") <= k + 1)
    first = first.groupBy("one").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pairs = merged.select("id", F.explode("near").alias("x")).select(F.col("id").alias("from"), "x.loss", F.col("x.id").alias("one")).join(first, "one", "left")
    pairs = pairs.select("from", "loss", F.explode(F.coalesce("ids", F.array("one"))).alias("id"))
    own = first.select(F.col("one").alias("from"), F.lit(-1.0).alias("loss"), F.explode("ids").alias("id"))
    best = pairs.union(own).groupBy("from").agg(F.slice(F.sort_array(F.collect_list(F.struct("loss", "id"))), 1, k + 1).alias("near"))
    every = copies.union(keyed.where("n = 1").select("id", "id")).toDF("from", "id").join(best, "from")
    out = every.select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("at", "x"))
    return out.select(F.col("id").alias(id_col), F.col("x.id").alias("neighbour"), F.round(-F.col("x.loss"), 6).alias("similarity"), (F.col("at") + 1).alias("rank"))


def _runs(batches):
    """The batches cut where ordering, group or width change, with None at the end of each run."""
    last = None
    for pdf in batches:
        mark = pdf["grp"].fillna("\0null")
        change = (pdf["ordering"] != pdf["ordering"].shift()) | (mark != mark.shift()) | (pdf["dims"] != pdf["dims"].shift())
        for _, part in pdf.groupby(change.cumsum().to_numpy(), sort=True):
            name = (part["ordering"].iloc[0], mark[part.index[0]], part["dims"].iloc[0])
            if last is not None and name != last:
                yield None
            last = name
            yield part[["id", "dims", "vec"]]
    if last is not None:
        yield None


def _answers(held: pd.DataFrame, first: int, last: int, window: int, k: int) -> pd.DataFrame:
    dims = int(held["dims"].iloc[0])
    vectors = np.frombuffer(b"".join(held["vec"]), np.float16).reshape(-1, dims)
    ids = held["id"].to_list()
    at, cosines = _near(vectors, held["id"].to_numpy(), first, last, window, k)
    kept = np.isfinite(cosines)
    return pd.DataFrame({"id": ids[first:last], "losses": [-c[h] for c, h in zip(cosines.astype(np.float32), kept)], "near": [[ids[p] for p in row[h]] for row, h in zip(at, kept)]})
