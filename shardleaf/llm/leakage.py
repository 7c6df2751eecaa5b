"""Evaluation texts inside a corpus: SimHash windows, multi-index Hamming blocks, exact weighted-shingle check."""

import re
import unicodedata
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookalikes import IGNORABLE, LOOK_ALIKE

_FIRST = {c: cs[0] for cs in LOOK_ALIKE for c in cs[1:] if c.isalpha()}
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,60}>|&[a-z]{2,6};")
# Scripts written without blanks between words: each of their characters is a word.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
BETWEEN, LETTER, WORD, DIGIT, HIDDEN = range(5)
BLOCKS, BLOCK_BITS = 4, 16
SHINGLE = 5
SLICE = 1 << 20  # characters that are taken apart at once
_PRIME, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each character its kind (part of a word, a word, a digit, hidden or between words), and the one that stands for it."""
    kinds, fold = np.zeros(0x3FFFF, np.uint8), np.arange(0x3FFFF, dtype=np.uint64)
    for at in range(len(kinds)):
        c = chr(at)
        if c.isalnum():
            kinds[at] = LETTER if c.isalpha() else DIGIT
            low = _FIRST.get(c, c).lower()
            fold[at] = ord(_FIRST.get(low, low)) if len(low) == 1 else at
        elif at > 127 and (unicodedata.category(c) == "Cf" or IGNORABLE.match(c)):
            kinds[at] = HIDDEN
    for low, high in UNSPACED:
        part = kinds[low : high + 1]
        part[part == LETTER] = WORD
    return kinds, fold


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    factors = np.full((2, n), 1, np.uint64)
    factors[:, 1:] = [[_PRIME], [_INVERSE]]
    return tuple(np.cumprod(factors, axis=1))


def plain(text: str) -> str:
    """In compatibility form and without markup."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _TAG.sub(" ", text) if "<" in text or "&" in text else text


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def _slice_codes(text: str, digits: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of a text and the places where they begin, all words at once.

    Case, hidden characters and the choice among look-alike letters do not count.
    """
    kinds, fold = _characters()
    chars = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), len(kinds) - 1)
    kind, shown = kinds[chars], None
    if not text.isascii() and (hidden := kind == HIDDEN).any():
        shown = np.flatnonzero(~hidden)
        chars, kind = chars[shown], kind[shown]
    alone = kind == WORD
    inside = (kind == LETTER) | (kind == DIGIT) if digits else kind == LETTER
    edges = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero((edges[:-1] == 1) | alone), np.flatnonzero((edges[1:] == -1) | alone) + 1
    up, down = _powers(2 * SLICE if len(chars) < 2 * SLICE else len(chars) + 1)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(fold[chars] * up[: len(chars)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + np.uint64(0x51ED)), starts if shown is None else shown[starts]


def _slices(texts: list[str]):
    """(numbers of the texts, their slices): texts together up to a slice, a longer one by itself, cut at blanks."""
    held, size = [], 0
    for n, text in enumerate(texts):
        while len(text) > SLICE:
            at = max(text.rfind(" ", 0, SLICE), text.rfind("\n", 0, SLICE)) + 1 or SLICE
            if held:
                yield held
                held, size = [], 0
            yield [(n, text[:at])]
            text = text[at:]
        if size + len(text) > SLICE and held:
            yield held
            held, size = [], 0
        held.append((n, text))
        size += len(text) + 1
    if held:
        yield held


def word_codes(texts: list[str], digits: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of the texts in order, and the number of words of each text."""
    codes, counts = [], np.zeros(len(texts), np.int64)
    for held in _slices([plain(t) for t in texts]):
        found, starts = _slice_codes("\n".join(t for _, t in held), digits)
        borders = np.cumsum([len(t) + 1 for _, t in held])
        np.add.at(counts, [n for n, _ in held], np.diff(np.searchsorted(starts, borders), prepend=0))
        codes.append(found)
    return np.concatenate(codes or [np.empty(0, np.uint64)]), counts


def window_size(n_words: int) -> int:
    """A power of two of at most two fifths of the item: with steps of a quarter, any half of the item holds a whole window."""
    return max(4, 1 << int(np.log2(max(4.0, 0.4 * n_words))))


def _joined(codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of all runs of n words."""
    out = codes[: max(0, len(codes) - n + 1)].copy()
    for k in range(1, n):
        out = _mix(out * np.uint64(_PRIME) + codes[k : k + len(out)])
    return out


def _lanes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bits of each word's code and of the code of the pair that it begins, one byte a bit: eight bits to a number."""
    spread = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]
    lanes = spread[codes.view(np.uint8).reshape(-1, 8)]
    pairs = spread[_joined(codes, 2).view(np.uint8).reshape(-1, 8)]
    pairs[ends[ends <= len(pairs)] - 1] = 0
    lanes[: len(pairs)] += pairs
    return np.concatenate([lanes, np.zeros((1, 8), np.uint64)])  # so that the last window has an end


def _prints(lanes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words that begin at ``starts``; steps of a window add up without overflow."""
    if not len(starts):
        return np.empty(0, np.uint64)
    part = min(size, 64)
    cuts = (starts[:, None] + np.arange(0, size, part)[None]).ravel()
    ends = np.minimum(cuts + part, (np.repeat(starts, -(-size // part)) + size))
    both = np.stack([cuts, ends], axis=1).ravel()
    sums = np.add.reduceat(lanes[: ends.max() + 1], both, axis=0)[::2]
    counts = np.ascontiguousarray(sums).view(np.uint8).reshape(len(starts), -1, 64).sum(axis=1, dtype=np.int32)
    return np.packbits(counts * 2 > 2 * size - 1, axis=1).view(np.uint64)[:, 0]


def _window_starts(n_words: int, size: int) -> np.ndarray:
    """A quarter of a window apart; the last window ends with the text."""
    step = max(1, size // 4)
    return np.append(np.arange(0, n_words - size, step), n_words - size) if n_words >= size else np.empty(0, np.int64)


class ItemIndex:
    """Fingerprints of every window of every item, found from any fingerprint within the radius.

    Two fingerprints of 64 bits within 11 bits of each other are, in at least one of 4 blocks of 16 bits, within 2 bits.
    Every block value within 2 bits of an item's is listed, so no fingerprint within the radius is missed.
    Items come as word codes, with the number of items in which each of their shingles stands.
    """

    def __init__(self, items: list[tuple[object, np.ndarray, np.ndarray]], radius: int):
        self.radius, self.shingle = radius, SHINGLE
        flips = [0] + [sum(1 << b for b in c) for n in range(1, radius // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), n)]
        flips = np.array(flips, np.uint64)
        self.ids, self.shingles, self.orders, self.weights = [], [], [], []
        by_size: dict[int, list] = {}
        for item_id, codes, shared in items:
            size = min(window_size(len(codes)), len(codes))
            prints = _prints(_lanes(codes, np.array([len(codes)])), np.arange(len(codes) - size + 1), size)
            by_size.setdefault(size, []).append((prints, np.full(len(prints), len(self.ids))))
            self.ids.append(item_id)
            self.shingles.append(_joined(codes, self.shingle))
            self.orders.append(np.argsort(self.shingles[-1], kind="stable"))
            # What stands in many items (a question, say) tells little about any of them.
            of, w = 1 / (1 + np.log(np.maximum(1, shared))), np.zeros(len(codes))
            for k in range(self.shingle):
                w[k : k + len(of)] = np.maximum(w[k : k + len(of)], of)
            self.weights.append(w)
        self.sizes = {}
        for size, parts in by_size.items():
            prints, owner = (np.concatenate(x) for x in zip(*parts))
            both = np.unique(np.stack([prints, owner.astype(np.uint64)]), axis=1)
            prints, owner = both[0], both[1].astype(np.int64)
            tables = []
            for b in range(BLOCKS):
                block = (prints >> np.uint64(BLOCK_BITS * b)) & np.uint64(0xFFFF)
                near = (block[:, None] ^ flips[None]).astype(np.int64).ravel()
                order = np.argsort(near, kind="stable")
                tables.append((np.searchsorted(near[order], np.arange((1 << BLOCK_BITS) + 1)), (order // len(flips)).astype(np.int32)))
            self.sizes[size] = prints, owner, tables

    def matches(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``prints``, item) of all windows within the radius."""
        own, owner, tables = self.sizes[size]
        found = []
        for b, (begin, entries) in enumerate(tables):
            block = ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64(0xFFFF)).astype(np.int64)
            many = begin[block + 1] - begin[block]
            for part in np.array_split(np.arange(len(prints)), max(1, int(many.sum()) // 2_000_000)):
                n = many[part]
                at = np.repeat(part, n)
                first = np.repeat(begin[block[part]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                entry = entries[first + np.arange(len(at))]
                close = np.bitwise_count(prints[at] ^ own[entry]) <= self.radius
                found.append(np.stack([at[close], owner[entry[close]]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]

    def covered(self, item: int, at: np.ndarray, codes: np.ndarray) -> tuple[float, float]:
        """Shares of the item's words, plain and weighted, that shingles (places and codes) of one stretch hold."""
        own, weights = self.shingles[item], self.weights[item]
        order = self.orders[item]
        ranked = own[order]
        low, high = np.searchsorted(ranked, codes, "left"), np.searchsorted(ranked, codes, "right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return 0.0, 0.0
        n = (high - low)[hit]
        place = order[np.repeat(low[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        shift = np.repeat(at[hit], n) - place
        band = _band(len(own))  # words lost or added move the stretch's later part by as much
        bins = shift // band
        names, counts = np.unique(bins, return_counts=True)
        main = names[np.argmax(counts)]
        there = np.zeros(len(weights), bool)
        kept = place[np.abs(bins - main) <= 1]
        for k in range(self.shingle):
            there[kept[kept + k < len(there)] + k] = True
        return float(there.mean()), float(weights[there].sum() / weights.sum())


def _band(n_shingles: int) -> int:
    return 8 + n_shingles // 8


_built: dict[tuple, ItemIndex] = {}


def _index(known: pd.DataFrame, radius: int) -> ItemIndex:
    """The index of a group of items; the last one is kept by the worker for the next group of texts."""
    rows = sorted(zip(map(str, known["_item"]), known["_item"], known["_codes"], known["_shared"]), key=lambda r: r[0])
    token = (radius, tuple((r[0], np.array(r[2], np.int64).tobytes(), np.array(r[3], np.int64).tobytes()) for r in rows))
    if token not in _built:
        _built.clear()
        _built[token] = ItemIndex([(i, np.array(c, np.int64).view(np.uint64), np.array(s, float)) for _, i, c, s in rows], radius)
    return _built[token]


def _leaks(texts: pd.DataFrame, index: ItemIndex, sizes: list[int], least: float, least_weighted: float):
    """(row of ``texts``, item id, covered share) of each text and item that it holds."""
    lengths = texts["_n"].to_numpy()
    held = [(np.asarray(at, np.int64), np.asarray(codes, np.int64).view(np.uint64)) for at, codes in zip(texts["_at"], texts["_codes"])]
    for nth, size in enumerate(sizes):
        if size not in index.sizes:
            continue
        prints = [np.asarray(p[nth], np.int64).view(np.uint64) for p in texts["_prints"]]
        rows = np.repeat(np.arange(len(texts)), [len(p) for p in prints])
        starts = np.concatenate([_window_starts(n, size) if len(p) else np.empty(0, np.int64) for n, p in zip(lengths, prints)])
        places, items = index.matches(size, np.concatenate(prints))
        order = np.lexsort((starts[places], items, rows[places]))
        best: dict = {}
        last = None
        for p, item in zip(places[order], items[order]):
            row, at, reach = rows[p], starts[p], 2 * len(index.weights[item])
            if last is not None and last[:2] == (row, item) and at < last[2]:
                continue  # inside what was just looked at
            last = (row, item, at + reach // 2)
            a, b = np.searchsorted(held[row][0], (at - reach, at + reach))
            share, weighted = index.covered(item, held[row][0][a:b], held[row][1][a:b])
            if share >= least and weighted >= least_weighted:
                best[row, item] = max(share, best.get((row, item), 0))
        for (row, item), share in best.items():
            yield int(row), index.ids[item], share


class _Marks:
    """A bitmap of codes: ``has`` is true for each code put in, and for few others."""

    def __init__(self, log_bits: int):
        self.log_bits, self.bits = log_bits, np.zeros(1 << (log_bits - 3), np.uint8)

    def places(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([(c >> np.uint64(64 - self.log_bits)).astype(np.int64) for c in (codes, _mix(codes))])

    def has(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones(len(codes), bool)
        for at in self.places(codes):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _marked(codes: DataFrame, most_log_bits: int) -> _Marks:
    """The bitmap of a column of codes: sixteen bits a code, yet never more than 2 ** ``most_log_bits``.

    Each task fills its own bits; what is collected is at most one value for each byte of the bitmap.
    """
    marks = _Marks(min(most_log_bits, max(13, int(np.ceil(np.log2(16 * max(1, codes.count())))))))

    def bits(batches):
        for batch in batches:
            at = marks.places(batch.column(0).to_numpy().view(np.uint64)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 3, pa.int64()), pa.array((1 << (at & 7)).astype(np.int32))], names=["at", "bit"])

    found = codes.mapInArrow(bits, "at bigint, bit int").groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    marks.bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    return marks


def _candidates(hits: np.ndarray, n_words: int, classes: list[tuple[int, int]]) -> bool:
    """Whether enough places whose shingle stands in an item lie within an item's reach of each other.

    ``classes`` has (fewest shared shingles, words around) of each size of window. Fewer cannot cover the least share of
    any item of that size, so nothing that the exact check would accept is left out.
    """
    return any(len(hits) >= need and (hits[need - 1 :] - hits[: len(hits) - need + 1]).min() <= 2 * reach for need, reach in classes)


def find_leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id_col: str, item_text_col: str, radius: int = 11, least: float = 0.33, least_weighted: float = 0.2, block_items: int = 2000, group_words: int = 1_000_000, bitmap_log_bits: int = 27) -> DataFrame:
    """``id_col, item_id_col, covered``: the items that each text holds whole or in large part, in one stretch.

    A window of about two fifths of an item's words has a fingerprint (SimHash of its words and pairs of words). Every
    item window and every text window a quarter of its size apart are compared; all within ``radius`` bits are found.
    Then the text around is checked exactly: the words of the item covered by shared shingles of five words, at about
    the same distance from each other, must be ``least`` of all, and ``least_weighted`` when shingles that stand in n
    items weigh 1 / (1 + ln n). Half of an item with a tenth of its words changed covers about 0.41.

    Texts are read once: each gives its fingerprints and those of its shingles that stand in any item (told by a bitmap
    of sixteen bits a shingle of the items, 2 ** ``bitmap_log_bits`` in all at most). A text with too few of these for
    any item is left out. Texts and items then meet as tables, in groups of about ``group_words`` words of texts and
    ``block_items`` items: items never meet on the driver or in a broadcast, and more of them make more groups.

    In scripts without blanks each character is a word. Items of less than five words (digits count as words then)
    match where their words stand one after the other as they are. Null and empty texts and items without any word
    match nothing; of rows that repeat id and text one result row comes out per pair. Other columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text IS NOT NULL AND _text <> ''")
    wanted = items.select(F.col(item_id_col).alias("_item"), F.col(item_text_col).cast("string").alias("_text")).where("_text IS NOT NULL AND _item IS NOT NULL").distinct()
    id_type, item_type = given.schema["_id"].dataType, wanted.schema["_item"].dataType
    longs = T.ArrayType(T.LongType())

    def coded(batches):
        for pdf in batches:
            texts = pdf["_text"].to_list()
            rows = []
            for item, text in zip(pdf["_item"].to_list(), texts):
                codes, _ = word_codes([text])
                short = len(codes) < SHINGLE
                if short:
                    codes, _ = word_codes([text], digits=True)
                if len(codes):
                    rows.append((item, short, codes.view(np.int64), (np.empty(0, np.uint64) if short else _joined(codes, SHINGLE)).view(np.int64)))
            yield pd.DataFrame(rows, columns=["_item", "_short", "_codes", "_shingles"])

    own = wanted.mapInPandas(coded, T.StructType([T.StructField("_item", item_type), T.StructField("_short", T.BooleanType()), T.StructField("_codes", longs), T.StructField("_shingles", longs)])).checkpoint()
    long, short = own.where("NOT _short"), own.where("_short")
    spans: dict[int, list[int]] = {}
    for r in long.select(F.size("_codes").alias("n")).distinct().collect():  # as many rows as items have lengths
        spans.setdefault(window_size(r.n), []).append(r.n)
    sizes = sorted(spans)
    # Matched shingles lie within three bands of one shift, so within the item's length and three bands of each other.
    classes = [(max(1, -(-int(np.ceil(least * min(ns))) // SHINGLE)), max(ns) + 3 * _band(max(ns)) + SHINGLE) for ns in spans.values()]
    margin = max([r for _, r in classes] or [0])
    segment = max(20_000, 8 * margin)
    lengths = sorted(r.n for r in short.select(F.size("_codes").alias("n")).distinct().collect())
    marks = _marked(long.select(F.explode("_shingles").alias("c")).distinct(), bitmap_log_bits)
    firsts = _marked(short.select(F.element_at("_codes", 1).alias("c")).distinct(), bitmap_log_bits) if lengths else None
    shared = docs.sparkSession.sparkContext.broadcast((marks, firsts))

    def scan(batches):
        marks, firsts = shared.value
        for pdf in batches:
            ids, texts = pdf["_id"].to_list(), pdf["_text"].to_list()
            rows = []
            for low in range(0, len(texts), 256):
                part = texts[low : low + 256]
                if sizes:
                    codes, counts = word_codes(part)
                    ends = np.cumsum(counts)
                    shingles = _joined(codes, SHINGLE)
                    hits = np.flatnonzero(marks.has(shingles))
                    hits = hits[hits + SHINGLE <= ends[np.searchsorted(ends, hits, "right")]]
                    lanes = _lanes(codes, ends)
                    for text in np.flatnonzero(counts).tolist():
                        first = ends[text] - counts[text]
                        for at in range(first, max(first + 1, ends[text] - 2 * margin), segment):
                            end = min(ends[text], at + segment + 2 * margin)
                            inside = hits[np.searchsorted(hits, at) : np.searchsorted(hits, end - SHINGLE + 1)]
                            if _candidates(inside, end - at, classes):
                                prints = [_prints(lanes, at + _window_starts(end - at, size), size).view(np.int64) for size in sizes]
                                rows.append((ids[low + text], False, end - at, prints, (inside - at).astype(np.int32), shingles[inside].view(np.int64)))
                if firsts is not None:
                    codes, counts = word_codes(part, digits=True)
                    ends = np.cumsum(counts)
                    hits = np.flatnonzero(firsts.has(codes))
                    text = np.searchsorted(ends, hits, "right")
                    for n in lengths:
                        fits = hits + n <= ends[text]
                        found = {(t, codes[h : h + n].tobytes()) for t, h in zip(text[fits].tolist(), hits[fits].tolist())}
                        rows += [(ids[low + t], True, n, [], np.empty(0, np.int32), np.frombuffer(c, np.int64)) for t, c in found]
            yield pd.DataFrame(rows, columns=["_id", "_short", "_n", "_prints", "_at", "_codes"])

    fields = [("_id", id_type), ("_short", T.BooleanType()), ("_n", T.IntegerType()), ("_prints", T.ArrayType(longs)), ("_at", T.ArrayType(T.IntegerType())), ("_codes", longs)]
    parts = given.mapInPandas(scan, T.StructType([T.StructField(*f) for f in fields])).checkpoint()
    near = parts.where("NOT _short").drop("_short")
    words = near.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).head().n
    blocks, salts = max(1, -(-long.count() // block_items)), max(1, -(-words // group_words))
    counts = long.select("_item", F.explode(F.array_distinct("_shingles")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = long.select("_item", F.posexplode("_shingles").alias("at", "c")).join(counts, "c", "left")
    shares = places.groupBy("_item").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(1)).alias("n")))).alias("_p")).select("_item", F.col("_p.n").alias("_shared"))
    table = long.join(shares, "_item", "left").select("_item", "_codes", F.coalesce("_shared", F.array().cast("array<bigint>")).alias("_shared"), F.pmod(F.xxhash64("_item"), F.lit(blocks)).cast("int").alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    asked = near.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.pmod(F.xxhash64("_id", "_codes"), F.lit(salts)).cast("int").alias("_salt"))

    def compare(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        found = list(_leaks(texts, _index(known, radius), sizes, least, least_weighted)) if len(texts) and len(known) else []
        ids = texts["_id"].to_list()
        return pd.DataFrame({"_id": [ids[n] for n, _, _ in found], "_item": [i for _, i, _ in found], "covered": [c for _, _, c in found]})

    found = T.StructType([T.StructField("_id", id_type), T.StructField("_item", item_type), T.StructField("covered", T.DoubleType())])
    partial = asked.groupBy("_block", "_salt").cogroup(table.groupBy("_block", "_salt")).applyInPandas(compare, found)
    exact = parts.where("_short").select("_id", "_codes").join(short.select("_item", "_codes"), "_codes").select("_id", "_item", F.lit(1.0).alias("covered"))
    return partial.unionByName(exact).groupBy(F.col("_id").alias(id_col), F.col("_item").alias(item_id_col)).agg(F.max("covered").alias("covered"))
