"""Rows that travel or are written in packs: many rows as one value of compressed columns, a fraction of what they take one by one."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_pack", T.BinaryType())])


def _lists(array: pa.Array, values) -> pa.Array:
    return pa.ListArray.from_arrays(array.offsets, values(array.values), mask=array.is_null() if array.null_count else None)


def _encoded(array: pa.Array, within: bool = False) -> pa.Array:
    """Each string within lists once."""
    if pa.types.is_list(array.type):
        return _lists(array, lambda values: _encoded(values, True))
    return array.dictionary_encode() if within and pa.types.is_string(array.type) else array


def _decoded(array: pa.Array) -> pa.Array:
    if pa.types.is_list(array.type):
        return _lists(array, _decoded)
    return array.dictionary_decode() if pa.types.is_dictionary(array.type) else array


def _pack(rows: pa.Table) -> bytes:
    columns = [_encoded(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)) for c in rows.columns]
    batch = pa.RecordBatch.from_arrays(columns, names=rows.column_names)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def rows_of(pack: bytes) -> pa.RecordBatch:
    batch = pa.ipc.open_stream(pack).read_next_batch()
    return pa.RecordBatch.from_arrays([_decoded(c) for c in batch.columns], names=batch.schema.names)


def packed(df: DataFrame, once: str | None = None, by: Callable | None = None, most: int = 8_000_000) -> DataFrame:
    """``_part, _pack``: the rows of each ``_part`` (0 where there is no such column), packed in each task whenever ``most`` bytes have come.

    Of rows of a part with the same ``once`` that come together, one is kept. ``by`` makes other batches of those of ``df`` first.
    """

    def parts(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        part, at = np.zeros(len(table), np.int32), np.arange(len(table))
        if "_part" in table.column_names:
            part, table = table["_part"].to_numpy(), table.drop_columns("_part")
        if once is not None:
            codes = table[once].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
            at = np.sort(np.unique((codes + 1) * (int(part.max()) + 1) + part, return_index=True)[1])
        at = at[np.argsort(part[at], kind="stable")]
        names, begin = np.unique(part[at], return_index=True)
        made = [_pack(table.take(pa.array(one))) for one in np.split(at, begin[1:])]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(made, pa.binary())], names=SCHEMA.names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches if by is None else by(batches):
            if len(batch):
                held.append(batch)
                size += batch.nbytes
            if size >= most:
                yield parts(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield parts(held)
        held = None
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(pack, SCHEMA)


def unpacked(packs: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of packs of this schema."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.column("_pack"):
                yield rows_of(pack.as_py())
            pa.default_memory_pool().release_unused()

    return packs.select("_pack").mapInArrow(unpack, schema)


def written(df: DataFrame, once: str | None = None, by: Callable | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The rows, or those of the ``schema`` that ``by`` makes of them, written once as packs."""
    return unpacked(packed(df, once, by).checkpoint(), schema or df.schema)


def in_order(df: DataFrame, by: str, part_rows: int = 4096) -> DataFrame:
    """The rows in the order of a column, those of a stretch of it in one partition, as ``orderBy``; they travel packed.

    A few of the column's values, taken at random, tell where stretches begin, which only decides how even they are.
    """
    rows = df.count()
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // part_rows))
    if parts < 2:
        return df.coalesce(1).sortWithinPartitions(by)
    some = sorted(r[0] for r in df.select(by).where(F.col(by).isNotNull()).sample(min(1.0, 64 * parts / rows), seed=1).collect())
    bounds = sorted({some[len(some) * i // parts] for i in range(1, parts)}) if some else []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(by))) if bounds else F.lit(0)
    packs = packed(df.withColumn("_part", F.greatest(part, F.lit(0)).cast("int"))).repartitionById(parts, "_part")
    return unpacked(packs, df.schema).sortWithinPartitions(by)
