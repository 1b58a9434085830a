"""Document fingerprints by Order MinHash: least occurrence-numbered k-mers, kept in text order."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import n_partitions

K, PICK, SKETCHES = 6, 2, 64
_rng = np.random.default_rng(2019)
_MULT = (_rng.integers(0, 2**31, SKETCHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_COLUMNS = 1 << 12


def _numbered(grams: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each k-mer with the number of its earlier occurrences."""
    n = len(grams)
    bits = max(1, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    ranked = np.sort((grams & ~low) | np.arange(n, dtype=np.uint64))
    place, value = (ranked & low).astype(np.int64), ranked & ~low
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(np.concatenate(([True], value[1:] != value[:-1])), at, 0))
    out = np.empty(n, np.uint64)
    out[place] = (at - first).astype(np.uint64)
    return (rolling.mix(grams + out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _grams(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k code points."""
    letters = points.astype(np.uint64) + np.uint64(1)
    letters *= np.uint64(0x9FB21C651E98DF25)
    letters ^= letters >> np.uint64(29)
    n = len(points) - k + 1
    out = letters[:n].copy()
    for i in range(1, k):
        out *= rolling.BASE
        out += letters[i : n + i]
    return out


def sketch(points: np.ndarray, k: int = K) -> np.ndarray:
    """64 symbols of 16 bits for a text given as code points (uint32).

    Each hash function picks the two least numbered k-mers; their hashes in text order make the symbol. Texts
    shorter than k are one k-mer; an empty text has symbols of its own.
    """
    if len(points) == 0:
        return np.full(SKETCHES, 0xE0E0, np.uint16)
    items = _numbered(_grams(points, min(k, len(points))))
    values, places = [], []
    for at in range(0, len(items), _COLUMNS):
        x = items[None, at : at + _COLUMNS] * _MULT
        flat, rows = x.reshape(-1), np.arange(SKETCHES) * x.shape[1]
        for _ in range(min(PICK, x.shape[1])):
            where = x.argmin(axis=1)
            values.append(flat[rows + where])
            places.append(where + at)
            flat[rows + where] = np.iinfo(np.uint32).max
    place = np.stack(places, 1)
    if len(places) > PICK:
        least = np.lexsort((place, np.stack(values, 1)), axis=1)[:, :PICK]
        place = np.take_along_axis(place, least, 1)
    picked = items[np.sort(place, axis=1)].astype(np.uint64)
    symbol = picked[:, 0] * np.uint64(0xA0761D6478BD642F)
    if picked.shape[1] > 1:
        symbol = rolling.mix(symbol) + picked[:, 1]
    return (rolling.mix(symbol) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _text(x: np.ndarray) -> str:
    return x.astype(">u2").tobytes().hex()


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def _pairs(k: int):
    """Rows come by run, and within it in descending order; the last row of a run is only the next of the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        last: tuple | None = None
        for batch in batches:
            out = []
            for run_id, guest, ident, text in zip(*batch.columns):
                run_id, guest, ident = run_id.as_py(), guest.as_py(), ident.as_py()
                points = _points(text.as_py())
                own = sketch(points, k)
                if last is not None and last[0] == run_id and not last[1]:
                    _, _, before, before_points, before_own = last
                    half = len(before_points) // 2
                    edited = np.concatenate((before_points[: len(before_points) - half], points[:half]))
                    edited_own = sketch(edited, k) if half else before_own
                    sha = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before, len(before_points), sha, _text(before_own), _text(edited_own), likeness(before_own, edited_own), likeness(before_own, own)))
                last = (run_id, guest, ident, points, own)
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def fingerprint_edits(docs: DataFrame, ident: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    A row's edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document's, in descending order of id; the first document follows the last. Likeness is the
    share of equal symbols. Fingerprints are 64 symbols of 16 bits as hex; equal texts have equal ones.

    Null texts count as empty (n_chars 0); null ids come last; rows of equal ids are ordered by text; a
    table of one row is its own next; an empty table gives no rows; other columns are ignored.

    One shuffle moves the texts into runs of neighbouring rows, one a partition, in the order of id and text
    hash. A run also gets a copy of the first row of the next run, so the pairs across runs need no second
    shuffle. Where runs begin is found by ranging the ids and hashes alone; these first places, two a
    partition of the shuffle, are all that the driver sees.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").isNull().alias("last"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).cast("long").alias("down"), F.xxhash64("text").alias("tie")]
    ranged = narrow.select(*order).repartitionByRange(2 * n_partitions(spark), "last", "down", "tie")
    first = F.min(F.struct("last", "down", "tie")).alias("first")
    heads = sorted(tuple(r.first) for r in ranged.groupBy(F.spark_partition_id().alias("part")).agg(first).collect())
    if not heads:
        return narrow.limit(0).select(F.lit(0).alias("run"), F.lit(0).alias("guest"), "doc_id", "text").mapInArrow(_pairs(k), _SCHEMA)

    @F.pandas_udf("array<int>")
    def runs_of(last: pd.Series, down: pd.Series, tie: pd.Series) -> pd.Series:
        """The run of a row; of the first row of a run also the run before it (of the first run, the last)."""
        out = []
        for place in zip(last, down, tie):
            own = bisect_right(heads, place) - 1
            out.append([own, (own - 1) % len(heads)] if place == heads[own] else [own])
        return pd.Series(out)

    seats = narrow.select("doc_id", "text", *order).withColumn("runs", runs_of("last", "down", "tie"))
    dealt = seats.select("doc_id", "text", "last", "down", "tie", F.posexplode("runs").alias("guest", "run"))
    ordered = dealt.repartitionById(len(heads), "run").sortWithinPartitions("run", "guest", "last", "down", "tie")
    return ordered.select("run", "guest", "doc_id", "text").mapInArrow(_pairs(k), _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
