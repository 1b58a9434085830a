"""Word shingles as 64-bit hashes, and which of them several texts share: the document frequencies of all shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, n_partitions
from .rolling import mix

#: Shingles that a block of texts and a bucket of frequencies hold on average; a few such arrays are in memory at a time.
BLOCK_SHINGLES, BUCKET_SHINGLES = 3_000_000, 2_000_000
#: Bits of a shingle that frequencies tell apart. Two shingles that agree in these count together, which only makes them look more frequent.
_KEY = 47
#: Levels of the rounded logarithm of a frequency: as many to a factor of two; 0 stands for a shingle of one text only.
LEVELS = 7


class _Words(dict):
    """xxh3 hashes of words seen lately; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles (A-Z lower-cased, words between ASCII white space).

    Fewer words than width make one shingle; no words, none. The hash mixes the words' hashes in order.
    """
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    each = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out + each[k : k + n])
    return np.unique(out)


def block_of(ident: str, blocks: int):
    return F.pmod(F.xxhash64(ident), F.lit(blocks)).alias("block")


def in_blocks(texts: DataFrame, shingles: int) -> DataFrame:
    """texts (id binary, text) with their `block`, in buckets of it; shingles is how many they have together, or more."""
    n = n_partitions(texts.sparkSession)
    blocks = n * max(1, -(-shingles // (n * BLOCK_SHINGLES)))
    return bucketed(texts.select("id", "text", block_of("id", blocks)).repartition(n, "block"), "block")


def _sets(table: pa.Table, width: int) -> tuple[list[bytes], list[np.ndarray]]:
    """Ids and sets of a block; of rows with one id, one stays."""
    ids, sets, seen = [], [], set()
    for ident, text in zip(table["id"].to_pylist(), table["text"]):
        if ident not in seen:
            seen.add(ident)
            ids.append(ident)
            sets.append(shingle_set(text.as_py(), width))
    return ids, sets


def _edges(buckets: int) -> np.ndarray:
    """Where the buckets of shingles begin, after the first."""
    return np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)


def _planes(x: np.ndarray, size: int) -> bytes:
    """Numbers byte by byte, all lowest bytes first: high bytes are zeros that compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _from_planes(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _counted(width: int, buckets: int):
    """A block's distinct shingles with the number of its sets that have them, cut into buckets."""

    def run(table: pa.Table) -> pa.Table:
        _, sets = _sets(table, width)
        every, counts = np.unique(np.concatenate(sets), return_counts=True)
        cuts = np.searchsorted(every, _edges(buckets))
        rows = [(b, k, c) for b, (k, c) in enumerate(zip(np.split(every, cuts), np.split(counts, cuts))) if len(k)]
        gaps = [_planes(np.diff(k >> np.uint64(64 - _KEY), prepend=np.uint64(0)), 6) for _, k, _ in rows]
        block = [table["block"][0].as_py()] * len(rows)
        arrays = [pa.array([b for b, *_ in rows], pa.int32()), pa.array(block, pa.int64()), pa.array(gaps, pa.binary()), pa.array([_planes(c, 4) for *_, c in rows], pa.binary())]
        return pa.Table.from_arrays(arrays, names=["bucket", "block", "gaps", "counts"])

    return run


def _levelled(table: pa.Table) -> pa.Table:
    """For each block's shingles of a bucket, the level of the frequency in all blocks, one byte each."""
    keys = [np.cumsum(_from_planes(x.as_py(), 6)) for x in table["gaps"]]
    counts = np.concatenate([_from_planes(x.as_py(), 4) for x in table["counts"]])
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    frequency = np.bincount(place, weights=counts, minlength=len(every))
    level = np.where(frequency > 1, np.clip(np.round(LEVELS * np.log2(frequency)), 1, 255), 0).astype(np.uint8)[place]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return pa.Table.from_arrays([table["block"].combine_chunks(), table["bucket"].combine_chunks(), pa.array([x.tobytes() for x in np.split(level, cuts)], pa.binary())], names=["block", "bucket", "levels"])


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of n, in any order common to all sets, one of which every set at the similarity has among its own first ones."""
    return n + (-percent * n // 100) + 1


def match_count(levels: np.ndarray, first: int, n: int) -> int:
    """How many shared tokens to ask of the prefix, so that the estimated cost of the set's candidates is least.

    levels are those of the shared tokens in order, first of them are in the prefix of one match. Asking for k
    matches lengthens the prefix by k - 1 tokens. Of the candidates that one match gives, the sum of the first
    frequencies, all compare prefixes; about (sum of the frequencies in the prefix) / k have k matches and go on to be
    verified on n tokens.
    """
    sums = np.cumsum(2.0 ** (levels.astype(np.float64) / LEVELS))[first - 1 :]
    k = np.arange(1, len(sums) + 1)
    return int(np.argmin(sums[0] * (first + k - 1) + sums / k * n)) + 1


def _shared(width: int, percent: int):
    """(id, n, first, matches, weight, tokens) of each set; the last four are null unless it may have a partner at the similarity."""

    def run(texts: pa.Table, levels: pa.Table) -> pa.Table:
        ids, sets = _sets(texts, width) if texts.num_rows else ([], [])
        out = []
        if sets:
            every = np.unique(np.concatenate(sets))
            held = levels.sort_by("bucket")["levels"]
            level = np.frombuffer(b"".join(x.as_py() for x in held), np.uint8)
            every, level = every[level > 0], level[level > 0]
            for ident, own in zip(ids, sets):
                place = np.searchsorted(every, own)
                place[place == len(every)] = 0
                mine = every[place] == own if len(every) else np.zeros(len(own), bool)
                n_shared = int(np.count_nonzero(mine))
                first = min(n_shared, prefix_length(len(own), percent) - (len(own) - n_shared))
                if first <= 0:
                    out.append((ident, len(own), None, None, None, None))
                    continue
                shared, at = own[mine], level[place[mine]]
                order = np.lexsort((shared, at))
                at = at[order]
                weight = int((2.0 ** (at[:first].astype(np.float64) / LEVELS)).sum())
                out.append((ident, len(own), first, match_count(at, first, len(own)), weight, shared[order].astype("<u8").tobytes()))
        types = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.Table.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["id", "n", "first", "matches", "weight", "tokens"])

    return run


def shared_shingles(blocks: DataFrame, shingles: int, width: int, percent: int) -> DataFrame:
    """(id, n, first, matches, weight, tokens) of the texts of in_blocks().

    n is the size of the set, tokens its shingles that another id's set has too, rarest first (frequency level, then
    hash, the same order for all). first of them are in the prefix that holds a token of every partner's
    prefix, weight adds their frequencies, matches: see match_count. Of sets whose prefix has only shingles of their own,
    which have no partner at the similarity, all but id and n is null.

    The frequencies count all shingles of all blocks. A shingle goes to its bucket once a block, not once a
    text, so a frequent one is added up before it is shuffled; what returns to a block is one byte a shingle.
    """
    buckets = max(n_partitions(blocks.sparkSession), -(-shingles // BUCKET_SHINGLES))
    counted = blocks.groupBy("block").applyInArrow(_counted(width, buckets), "bucket int, block long, gaps binary, counts binary")
    levels = counted.groupBy("bucket").applyInArrow(_levelled, "block long, bucket int, levels binary")
    fields = "id binary, n long, first int, matches int, weight long, tokens binary"
    return blocks.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(_shared(width, percent), fields)
