"""Suffix-array dedup: repeated 400-byte strings found by prefix doubling over ranked positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import bucketed, discard, written

#: Bytes that ranks cover after the rounds at a quarter and half of it as offsets; the last rounds double once more.
GRAM = 256
#: Starts that one pair decides at once, round by round; each divides the one before it.
WIDTHS = (49, 7, 1)
#: Windows looked at together; bounds a task's memory on very long texts.
CHUNK = 1 << 20
_POS = np.uint64(24)
_HIGH = ~((np.uint64(1) << _POS) - np.uint64(1))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def gram_ranks(data: np.ndarray, gram: int) -> np.ndarray:
    """The rank (a 64-bit name) of the gram that starts at each byte."""
    if len(data) < gram:
        return np.empty(0, np.uint64)
    sums = rolling.prefix(data)
    starts = np.arange(len(data) - gram + 1)
    return rolling.spans(sums, starts, starts + gram)


def anchors(ranks: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): each place that is the leftmost least rank of some window of `span` grams, and
    the first and last start of the windows that it stands for. Equal windows have equal anchors."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(ranks) - span + 1, CHUNK):
        part = ranks[at : at + CHUNK + span - 1]
        least, width = (part & _HIGH) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(part) - span + 1], least[span - width :][: len(part) - span + 1])
        place = (least & ~_HIGH).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate(([0], cut))
        found.append((place[first] + at, first + at, np.concatenate((cut, [len(place)])) - 1 + at))
    if not found:
        return (np.empty(0, np.int64),) * 3
    place, first, last = (np.concatenate(x) for x in zip(*found))
    new = np.concatenate(([True], np.diff(place) != 0))
    return place[new], first[new], last[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(new) - 1]))]


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _emit(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    cols = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(len(names))]
    return pa.RecordBatch.from_arrays([_longs(c) for c in cols], names=names)


def _same(values: list[int], n: int) -> list[np.ndarray]:
    return [np.full(n, v, np.int64) for v in values]


def quarters(gram: int) -> tuple[int, list[int]]:
    """Bytes that the first ranks cover, and the places of four of them that cover a gram."""
    own = -(-gram // 4)
    return own, [0, min(own, gram - own), max(0, gram - 2 * own), gram - own]


def _round_one(length: int, gram: int):
    """Anchors of each text with the rank of their first quarter gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "place", "first", "last", "rank"]
        for batch in batches:
            parts, held = [], 0
            for k1, k2, text in zip(*(batch.column(i) for i in range(3))):
                data = _bytes(text.as_py())
                place, first, last = anchors(gram_ranks(data, gram), length - gram + 1)
                if len(place):
                    parts.append([*_same([k1.as_py(), k2.as_py()], len(place)), place, first, last, gram_ranks(data, quarters(gram)[0])[place]])
                    held += len(place)
                if held > 200_000:
                    yield _emit(parts, names)
                    parts, held = [], 0
            yield _emit(parts, names)

    return run


def _at_offsets(gram: int):
    """The four ranks of quarter grams from each anchor in hits on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "place", "first", "last", "r0", "r1", "r2", "r3"]
        own, offsets = quarters(gram)
        for batch in batches:
            parts = []
            for k1, k2, text, hits in zip(*(batch.column(i) for i in range(4))):
                ranks = gram_ranks(_bytes(text.as_py()), own)
                place, first, last = (hits.values.field(n).to_numpy().astype(np.int64) for n in ("place", "first", "last"))
                parts.append([*_same([k1.as_py(), k2.as_py()], len(place)), place, first, last, *(ranks[place + x] for x in offsets)])
            yield _emit(parts, names)

    return run


def _pairs(length: int, gram: int, width: int):
    """Pairs of ranks for aligned stretches of `width` starts around the anchors in hits.

    Stretch j of anchor a holds the starts a - (j + 1) * width + 1 .. a - j * width, so that copies cut their
    stretches at equal places. c1, c2 rank the core, the bytes that all its windows have in common; h1, h2
    all bytes of its windows; whole is 0 where the text ends inside these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "place", "first", "last", "open", "j", "whole", "c1", "c2", "h1", "h2"]
        for batch in batches:
            parts, held = [], 0
            for k1, k2, text, hits in zip(*(batch.column(i) for i in range(4))):
                data = _bytes(text.as_py())
                ranks = gram_ranks(data, gram)
                own = hits.values
                place, first, last, undecided = (own.field(n).to_numpy().astype(np.int64) for n in ("place", "first", "last", "open"))
                low, high = (place - last) // width, (place - first) // width
                n = high - low + 1
                at = np.repeat(np.arange(len(place)), n)
                j = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                a = place[at]
                begin, end = a - (j + 1) * width + 1, a - j * width
                whole = (begin >= 0) & (end + length <= len(data))
                clip = lambda x: np.clip(x, 0, len(ranks) - 1)
                parts.append([
                    *_same([k1.as_py(), k2.as_py()], len(at)), a, np.maximum(first[at], begin), np.minimum(last[at], end), undecided[at], j,
                    whole.astype(np.int64), ranks[end], ranks[begin + length - gram], ranks[clip(begin)], ranks[clip(end + length - gram)],
                ])
                held += len(at)
                if held > 100_000:
                    yield _emit(parts, names)
                    parts, held = [], 0
            yield _emit(parts, names)

    return run


def _cut(length: int):
    """What remains of each text, and the removed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, copies, text, hits in zip(*(batch.column(i) for i in range(5))):
                data = text.as_py().encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                if copies.as_py() > 1 and len(data) >= length:
                    spans = [[0, len(data)]]
                elif hits.is_valid:
                    own = hits.values
                    first, last = own.field("first").to_numpy(), own.field("last").to_numpy()
                    for i in np.lexsort((last, first)):
                        if spans and first[i] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], int(last[i]) + length)
                        else:
                            spans.append([int(first[i]), int(last[i]) + length])
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((k1.as_py(), k2.as_py(), len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), spans))
            cols = list(zip(*out)) if out else [()] * 8
            types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def _by_text(texts: DataFrame, info: DataFrame, fields: list[str]) -> DataFrame:
    """Texts that have rows in info, with these gathered (a text's rows are bounded by its length)."""
    gathered = info.groupBy("k1", "k2").agg(F.collect_list(F.struct(*fields)).alias("hits"))
    return texts.join(gathered, ["k1", "k2"])


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose rank is not unique. The ranks that are shared are a written side of their own, so that Spark can split hot ones."""
    return rows.join(written(rows.groupBy("rank").agg(F.count("*").alias("n")).filter("n > 1").select("rank")), "rank")


def repeated_spans(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, spans) for each row.

    Removed is every byte covered by a `length`-byte string that starts anywhere else too, in any text or
    the same one. Texts are whole UTF-8 bytes, null counts as empty; matches never cross texts; a text that
    occurs twice or more is removed whole if it has `length` bytes. text is what remains, with U+FFFD where a
    run begins or ends within a character (kept_sha256 is of the bytes); spans lists the removed runs as
    [begin, end). Repeated rows, ids and clashing extra columns don't matter; an empty table gives no rows.

    Prefix doubling over position-rank pairs, in rounds of Spark jobs; each round pairs a position's rank with
    the rank at a growing offset, names the pair by a new rank, and only positions that share theirs go on:
    1. each window of `length` bytes is represented by its anchor, the position of its least 256-byte rank;
       positions are ranked by their first 64 bytes (a 64-bit name of the string);
    2. at offset 64 and then 128, pairs of ranks are reranked, which covers 256 bytes;
    3. at an offset up to 256, the last pairs cover `length` bytes. For a stretch of 49 starts, one pair covers
       the bytes that all its windows share, one all their bytes. If the second is not alone, all 49 starts
       are decided; if the first is alone, none repeats; other stretches go on, one for all equal ones;
    4. the same for stretches of 7 and of 1, where a pair covers exactly one window.
    Equal windows have equal anchors and so equal stretches, hence no repeat is missed. Tables that no later
    round reads are deleted on the way.
    """
    gram = min(GRAM, max(1, length * 16 // 25))
    if length > 2 * gram:
        raise ValueError(f"length can be {2 * GRAM} at most")
    most = min(2 * gram - length, length - gram) + 1
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(ident).alias("doc_id"), F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(5), whole).alias("k2"), whole.alias("text"))
    once = keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("text").alias("text"))  # copies fold before the shuffle
    texts = bucketed(once, "k1", "k2")
    long_enough = texts.filter(F.octet_length("text") >= length).select("k1", "k2", "text")

    seat = ["k1", "k2", "place", "first", "last"]
    one = written(long_enough.mapInArrow(_round_one(length, gram), _longs_of(*seat, "rank")))
    offsets = written(_by_text(long_enough, _shared(one), seat[2:]).mapInArrow(_at_offsets(gram), _longs_of(*seat, "r0", "r1", "r2", "r3")))
    discard(one)
    pairs = offsets.select(*seat, F.xxhash64("r0", "r1").alias("rank"), F.xxhash64("r2", "r3").alias("next"))
    halves = written(_shared(pairs).select(*seat, F.xxhash64("rank", "next").alias("rank")))
    hits = _shared(halves).select(*seat, F.lit(1).cast("long").alias("open"))
    found = []
    for width in [w for w in WIDTHS if w <= most]:
        texts_hit = _by_text(long_enough, hits, [*seat[2:], "open"])
        rows = written(texts_hit.mapInArrow(_pairs(length, gram, width), _longs_of(*seat, "open", "j", "whole", "c1", "c2", "h1", "h2")))
        core, string = ["j", "c1", "c2"], ["j", "c1", "c2", "h1", "h2"]
        classes = rows.filter("whole = 1").groupBy(*string).agg(F.count("*").alias("n"), F.max("open").alias("open"), F.min(F.struct(*seat)).alias("seat"))
        cut_off = rows.filter("whole = 0").select(*string, F.lit(1).cast("long").alias("n"), "open", F.struct(*seat).alias("seat"))
        classes = written(classes.union(cut_off).withColumn("open", F.when(F.col("n") == 1, F.col("open")).otherwise(0)))
        shared_string = classes.filter("n > 1").select(*string)
        found.append(written(rows.filter("whole = 1 and open = 1").join(shared_string, string, "left_semi").select("k1", "k2", "first", "last")))
        mixed = classes.groupBy(*core).agg(F.count("*").alias("strings"), F.max("open").alias("undecided")).filter("strings > 1 and undecided = 1")
        hits = classes.join(written(mixed.select(*core)), core, "left_semi").select("seat.*", "open")
        discard(rows)
    gathered = reduce(DataFrame.union, found).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("hits"))
    fields = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, spans array<array<long>>"
    cut = written(texts.join(gathered, ["k1", "k2"], "left").select("k1", "k2", "copies", "text", "hits").mapInArrow(_cut(length), fields))
    discard(texts, offsets, halves, *found)
    return keyed.select("doc_id", "k1", "k2").join(cut, ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "spans")


def _longs_of(*names: str) -> str:
    return ", ".join(f"{n} long" for n in names)
