"""Hard-negative mining: distributed radix selection over integer scores of blocks of anchors against all rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, n_partitions, written

#: Buckets of a histogram: the size of a digit.
DIGIT = 4096
#: Bytes of anchors (vectors and windows) that are broadcast at once; more anchors are taken in turns.
BLOCK_BYTES = 32 << 20
#: Anchors that are scored with one batch of rows at a time.
TILE = 256
_LONG = 2**63 - 1
_ALL_IDS = 2**64 - 1


def _integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(256 * x) of each component, one row a vector; short vectors are filled up with zeros."""
    flat = np.floor(256.0 * np.asarray(vectors.flatten(), np.float64))
    sizes = np.asarray(vectors.value_lengths(), np.int64)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles hold all sums below 2^53, other ones are added as whole numbers and kept within 64 bits."""
    top = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * anchors.shape[1]
    if top < 2**53:
        return (anchors @ rows.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(anchors) @ whole(rows.T), -_LONG, _LONG).astype(np.int64)


@dataclass
class Windows:
    """Anchors, and for each of their windows where its kth row lies: the open ranges of score, id and row number.

    Rows rank by score downwards, then id and row number upwards. A window takes rows of its anchor's label
    (same) or of others, with scores from low to high. stage: 0 the score is open, 1 the id, 2 the row, 3 nothing.
    """

    row: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    same: bool
    owner: np.ndarray  # place of the window's anchor
    low: list[int]
    high: list[int]
    need: list[int]
    digit: int = field(default_factory=lambda: DIGIT)
    tile: int = field(default_factory=lambda: TILE)
    stage: list[int] = field(default_factory=list)
    score: list[tuple[int, int]] = field(default_factory=list)
    ident: list[tuple[int, int]] = field(default_factory=list)
    number: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        n = len(self.owner)
        self.score = list(zip(self.low, self.high))
        self.ident, self.number = [(0, _ALL_IDS)] * n, [(0, _LONG)] * n
        self.stage = [0 if lo <= hi else 3 for lo, hi in self.score]

    def open_range(self, w: int) -> tuple[int, int]:
        return (self.score, self.ident, self.number)[self.stage[w]][w]

    def width(self, lo: int, hi: int) -> int:
        return -(-(hi - lo + 1) // self.digit)

    def narrow(self, w: int, bucket: int, before: int, within: int) -> None:
        """The kth row is in this bucket, after so many rows that are taken; within is 0 if the window has fewer than k rows."""
        if not within:
            self.stage[w] = 3
            return
        stage, (lo, hi) = self.stage[w], self.open_range(w)
        width = self.width(lo, hi)
        found = (max(lo, hi - (bucket + 1) * width + 1), hi - bucket * width) if stage == 0 else (lo + bucket * width, min(hi, lo + (bucket + 1) * width - 1))
        (self.score, self.ident, self.number)[stage][w] = found
        self.need[w] -= before
        if within == self.need[w]:
            self.stage[w] = 3
        elif found[0] == found[1]:
            self.stage[w] += 1


def _tiles(windows: Windows, batch: pa.RecordBatch, wanted: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each wanted window: (window, places of its rows, their scores, ids as unsigned numbers, row numbers)."""
    number, label = np.asarray(batch.column(0)), np.asarray(batch.column(2))
    ident = np.asarray(batch.column(1).fill_null(_LONG)).view(np.uint64) ^ np.uint64(1 << 63)
    vectors = _integers(batch.column(3), windows.vectors.shape[1])
    by_anchor: dict[int, list[int]] = {}
    for w in wanted:
        by_anchor.setdefault(int(windows.owner[w]), []).append(w)
    anchors = sorted(by_anchor)
    for at in range(0, len(anchors), windows.tile):
        scores = _scores(windows.vectors[anchors[at : at + windows.tile]], vectors)
        for a, s in zip(anchors[at : at + windows.tile], scores):
            mine = label == windows.label[a]
            fits = mine & (number != windows.row[a]) if windows.same else ~mine
            for w in by_anchor[a]:
                at_rows = np.flatnonzero(fits & (s >= windows.low[w]) & (s <= windows.high[w]))
                if len(at_rows):
                    yield w, at_rows, s[at_rows], ident[at_rows], number[at_rows]


def _histogram(state):
    """(window, bucket, n): counts of the rows in the open range, best bucket first, until a batch alone has k of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = state.value
        wanted = [w for w, s in enumerate(windows.stage) if s < 3]
        for batch in batches:
            out = []
            for w, _, s, u, r in _tiles(windows, batch, wanted):
                stage, (lo, hi) = windows.stage[w], windows.open_range(w)
                width = windows.width(lo, hi)
                if stage == 0:
                    far = (np.int64(hi) - s[(s >= lo) & (s <= hi)]).astype(np.uint64) if hi - lo < 2**63 else np.array([hi - int(x) for x in s if lo <= x <= hi], np.uint64)
                else:
                    tied = s == windows.score[w][0]
                    if stage == 2:
                        tied &= u == np.uint64(windows.ident[w][0])
                    value = u[tied] if stage == 1 else r[tied].astype(np.uint64)
                    far = value[(value >= np.uint64(lo)) & (value <= np.uint64(hi))] - np.uint64(lo)
                bucket = far // np.uint64(width)
                if len(bucket) > windows.need[w]:
                    bucket = bucket[bucket <= np.partition(bucket, windows.need[w] - 1)[windows.need[w] - 1]]
                out.extend((w, int(b), int(n)) for b, n in zip(*np.unique(bucket, return_counts=True)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["window", "bucket", "n"])

    return run


def _gather(state):
    """(window, id, score, row) of the rows at or before the kth place of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = state.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for w, at, s, u, r in _tiles(windows, batch, [w for w in range(len(windows.owner)) if windows.low[w] <= windows.high[w]]):
                (s_lo, s_hi), (u_lo, u_hi), (_, r_hi) = windows.score[w], windows.ident[w], windows.number[w]
                tie = (u < np.uint64(u_lo)) | ((u <= np.uint64(u_hi)) & (r <= r_hi))
                keep = (s > s_hi) | ((s >= s_lo) & tie)
                ids = batch.column(1)
                for i, x, y in zip(at[keep], s[keep], r[keep]):
                    for column, value in zip(out, (w, ids[int(i)].as_py(), int(x), int(y))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["window", "id", "score", "row"])

    return run


def select_rows(rows: DataFrame, windows: Windows) -> DataFrame:
    """(window, id, score, row) of the first rows (need of them, or all) of each window; written.

    Each round counts the rows by one digit of the open range, summed up before and after the shuffle; the
    bucket of the kth row is located there and comes to the driver, one row a window of the block. Digits
    of the score come first, then, only for windows whose kth score is tied, of the id. The last pass gathers.
    """
    context = rows.sparkSession.sparkContext
    while any(s < 3 for s in windows.stage):
        state = context.broadcast(windows)
        counts = rows.mapInArrow(_histogram(state), "window long, bucket long, n long").groupBy("window", "bucket").agg(F.sum("n").alias("n"))
        needs = rows.sparkSession.createDataFrame([(w, windows.need[w]) for w, s in enumerate(windows.stage) if s < 3], "window long, need long")
        upto = F.sum("n").over(Window.partitionBy("window").orderBy("bucket"))
        kth = counts.withColumn("upto", upto).join(F.broadcast(needs), "window").filter("upto >= need").groupBy("window").agg(F.min(F.struct("bucket", F.expr("upto - n").alias("before"), "n")).alias("k"))
        found = {r.window: (r.k.bucket, r.k.before, r.k.n) for r in kth.collect()}
        for w, s in enumerate(windows.stage):
            if s < 3:
                windows.narrow(w, *found.get(w, (0, 0, 0)))
        state.unpersist()
    return written(rows.mapInArrow(_gather(context.broadcast(windows)), "window long, id long, score long, row long"))


def _finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def mine(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of floor(256 * x) with the anchor's vector. An anchor's positives are its first
    other rows of its label, by score downwards and id upwards; for each, the negatives are the first rows of
    other labels whose score is from low to high percent of the positive's. anchors is a condition on df's columns.

    Rows with a null label, a null vector or a null or non-finite component take no part; empty vectors score
    0, short ones count as filled up with zeros. Rows without id are candidates that come last among ties. Repeated
    rows are rows of their own: a copy of an anchor is its positive, and an anchor too. Scores beyond 64 bits
    count as the greatest number. An empty table gives no rows, other columns are ignored. Anchors are
    broadcast in blocks of BLOCK_BYTES at most, and each block is scored with all rows where they lie; nothing but
    counts and the rows selected is shuffled.
    """
    spark = df.sparkSession
    used = df.select(F.col(ident).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    used = used.filter("label is not null and v is not null").filter(_finite(F.col("v")))
    rows = written(used.repartition(n_partitions(spark)).select(F.monotonically_increasing_id().alias("row"), "id", "label", "v", "is_anchor"))
    dim, n = rows.agg(F.max(F.size("v")), F.sum(F.col("is_anchor").cast("long"))).first()
    blocks = -(-(n or 0) * (8 * (dim or 0) + 100 * (positives + 1)) // BLOCK_BYTES)
    parts = [_mined(rows.drop("is_anchor"), rows.filter("is_anchor").filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b), dim, positives, negatives, low, high) for b in range(blocks)]
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for part in parts:
        none = none.union(part)
    if not parts:
        discard(rows)
    return none


def _mined(rows: DataFrame, anchors: DataFrame, dim: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result of one block of anchors."""
    spark = rows.sparkSession
    block = anchors.orderBy("row").select("row", "id", "label", "v").toArrow()
    number, label = np.asarray(block["row"], np.int64), np.asarray(block["label"], np.int64)
    vectors = _integers(block["v"].combine_chunks(), dim)
    # No score is beyond what the largest components allow.
    top = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()[0] or 0.0
    most = [min(_LONG, int(min(float(np.abs(v).sum()) * (256 * top + 1), 1e19))) for v in vectors]
    near = Windows(number, label, vectors, True, np.arange(len(number)), [-m for m in most], most, [positives] * len(number))
    chosen = select_rows(rows, near).toArrow().sort_by([("window", "ascending"), ("score", "descending"), ("id", "ascending"), ("row", "ascending")])
    owner, scores = np.asarray(chosen["window"], np.int64), chosen["score"].to_pylist()
    span = [(-(-low * s // 100), high * s // 100) for s in scores]
    far = Windows(number, label, vectors, False, owner, [max(a, -_LONG) for a, _ in span], [min(b, _LONG) for _, b in span], [negatives] * len(scores))
    ids = block["id"].to_pylist()
    held = [(w, ids[o], i, s) for w, (o, i, s) in enumerate(zip(owner.tolist(), chosen["id"].to_pylist(), scores))]
    pairs = spark.createDataFrame(held, "window long, anchor_id long, positive_id long, positive_score long")
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    ranked = select_rows(rows, far).withColumn("rank", rank).join(pairs, "window")
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
