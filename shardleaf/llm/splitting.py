"""Cutting oversized texts into pieces at natural boundaries, by recursive bisection."""

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Boundaries as UTF-8 byte patterns, strongest first; the cut is at the end of the match.
_EOL = rb"(?:\r\n|\n|\r)"
PAUSES = tuple(
    re.compile(p)
    for p in (
        _EOL + rb"(?=[ \t]*#{1,6}[ \t])",  # before a heading
        _EOL + rb"[ \t]*" + _EOL + rb"+",  # blank line
        _EOL,  # line end
        rb"(?:[.!?]|\xe2\x80\xa6)[\"')\]]*(?:[ \t]|\xc2\xa0)+|\xe3\x80\x82|\xef\xbc[\x81\x9f]|\xd8\x9f[ \t]*",  # sentence end
    )
)
BLANKS = tuple(
    re.compile(p)
    for p in (
        rb"[,;:][ \t]+|\xe3\x80\x81|\xef\xbc\x8c",  # clause end
        rb"[ \t]+|\xc2\xa0|\xe3\x80\x80",  # blank
    )
)


def _nearest(patterns, text: bytes, lo: int, hi: int, mid: int) -> int | None:
    """Of the strongest pattern with a match ending inside (lo, hi), the end nearest to mid."""
    for pattern in patterns:
        ends = [m.end() for m in pattern.finditer(text, max(0, lo - 4), hi) if lo < m.end() < hi]
        if ends:
            return min(ends, key=lambda e: (abs(e - mid), e))
    return None


def _char_start(text: bytes, at: int, lo: int) -> int:
    """The start of the character holding byte ``at``, kept right of ``lo`` where a start exists there."""
    while at > lo and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _cut(text: bytes, lo: int, hi: int) -> int:
    mid, near = (lo + hi) // 2, (hi - lo) // 4
    for patterns in (PAUSES, BLANKS):
        for a, b in ((mid - near, mid + near), (lo, hi)):
            if (at := _nearest(patterns, text, a, b, mid)) is not None:
                return at
    return _char_start(text, mid, lo)


def _without_slivers(cores: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The spans with those of less than an eighth of the room joined to a neighbour, where both fit together."""
    out: list[tuple[int, int]] = []
    for lo, hi in cores:
        if out and hi - out[-1][0] <= room and min(hi - lo, lo - out[-1][0]) < room // 8:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def bisect(text: bytes, max_bytes: int, overlap_bytes: int) -> list[tuple[int, int, int]]:
    """(start with overlap, start, end) of each piece, as byte offsets; one piece if text is within max_bytes.

    The spans (start, end) tile the text. Each is at most ``max_bytes - overlap_bytes`` long, so that the piece
    with its overlap, which begins at a natural boundary where one lies in its first quarter, is within the limit.
    """
    if len(text) <= max_bytes:
        return [(0, 0, len(text))]
    room, cores, stack = max_bytes - overlap_bytes, [], [(0, len(text))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= room:
            cores.append((lo, hi))
            continue
        at = _cut(text, lo, hi)
        stack += [(at, hi), (lo, at)]
    pieces, before = [], None
    for lo, hi in _without_slivers(cores, room):
        start = lo
        if before is not None and overlap_bytes:
            first = max(before, lo - overlap_bytes)
            while first < lo and text[first] & 0xC0 == 0x80:
                first += 1
            snapped = _nearest((*PAUSES[2:], BLANKS[1]), text, first, lo - overlap_bytes * 3 // 4, first)
            start = first if snapped is None or first == before else snapped
        pieces.append((start, lo, hi))
        before = lo
    return pieces


def split_oversized(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = (), max_bytes: int = 1600, overlap_bytes: int = 160) -> DataFrame:
    """Pieces of at most ``max_bytes`` UTF-8 bytes of every text, in order, consecutive ones sharing about ``overlap_bytes``.

    Returns ``id_col``, the ``carry`` columns, ``piece_no`` (from 1), ``n_pieces``, ``start_byte`` (with the overlap),
    ``end_byte``, ``overlap_bytes`` and ``piece``. Dropping each piece's overlap and joining them gives the text back.
    Null and empty texts have no piece. Repeated rows and repeated ids give their pieces once per row. Other columns of
    ``df`` are ignored, whatever their names. The limit must leave room for the overlap and for one character of 4 bytes.

    A map over rows without shuffle: texts within the limit never leave the JVM.
    """
    if overlap_bytes < 0 or max_bytes - overlap_bytes < max(8, overlap_bytes):
        raise ValueError("the limit must leave room of at least the overlap and 8 bytes beside it")
    given = df.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text_col).cast("string").alias("_text")).where("_text <> ''")
    fields = [("piece_no", T.IntegerType()), ("n_pieces", T.IntegerType()), ("start_byte", T.LongType()), ("end_byte", T.LongType()), ("overlap_bytes", T.IntegerType()), ("piece", T.StringType())]

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField(*f) for f in fields])))
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for value in texts:
            if value is None:
                out.append(None)
                continue
            text = value.encode()
            pieces = bisect(text, max_bytes, overlap_bytes)
            out.append([{"piece_no": k, "n_pieces": len(pieces), "start_byte": start, "end_byte": end, "overlap_bytes": core - start, "piece": text[start:end].decode()} for k, (start, core, end) in enumerate(pieces, 1)])
        return pd.Series(out, dtype=object)

    size = F.octet_length("_text")
    whole = F.array(F.struct(F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("start_byte"), size.cast("long").alias("end_byte"), F.lit(0).alias("overlap_bytes"), F.col("_text").alias("piece")))
    pieces = given.withColumn("_cut", cut(F.when(size > max_bytes, F.col("_text")))).withColumn("_p", F.explode(F.coalesce("_cut", whole)))
    return pieces.select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], *[F.col(f"_p.{name}").alias(name) for name, _ in fields])
