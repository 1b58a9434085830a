"""MinHash near-dedup: multi-index Hamming join over b-bit signatures, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import bucketed, discard, n_partitions, written
from .linking import confirmed, linked, token_set
from .shingles import in_blocks, shared_shingles, shingle_set

#: 8 chunks of 6 symbols of 10 bits; a chunk may hold 1 wrong symbol. By pigeonhole every pair of signatures
#: that differ in at most 8 * (1 + 1) - 1 = 15 of 48 symbols shares a key.
CHUNKS, PER_CHUNK, SYMBOL_BYTES, SYMBOL_BITS = 8, 6, 2, 10
SYMBOLS = CHUNKS * PER_CHUNK
#: Pairs that share a key are compared on full sets up to this distance. A pair at similarity 0.80 lies beyond it
#: once in a million times, at 0.85 in a thousand million; at 0.4, four of five pairs do.
FARTHEST = 24
#: Bits of a parity of a set, and 64-bit numbers that hold them.
PARITY_BITS = 1024
PARITY_LANES = PARITY_BITS // 64
#: See linking.linked: once the parities exclude nearly all pairs that are no links, few rounds are better than few pivots.
PIVOTS, WIDEN = 32, 64
_rng = np.random.default_rng(85)
_MULT = (_rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_ADD = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)[:, None]


def signature(shingles: np.ndarray) -> bytes:
    """48 symbols: 10 bits of a hash of each of 48 minima, in two bytes each."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 14):
        np.minimum(least, (shingles[None, at : at + (1 << 14)] * _MULT + _ADD).min(axis=1), out=least)
    return (rolling.mix(least) >> np.uint64(64 - SYMBOL_BITS)).astype(">u2").tobytes()


def lanes(sign: bytes) -> list[int]:
    """A signature as one 64-bit number a chunk, so that distances are bit operations."""
    symbols = np.frombuffer(sign, ">u2").astype(np.int64).reshape(CHUNKS, PER_CHUNK)
    return (symbols << np.arange(0, SYMBOL_BITS * PER_CHUNK, SYMBOL_BITS)).sum(axis=1).tolist()


def _wrong(chunk: int | str, x: str = "lanes", y: str = "p_lanes") -> str:
    """The number of symbols in which a chunk of two signatures (columns of lanes) differs, as SQL."""
    low = sum((1 << SYMBOL_BITS - 1) - 1 << SYMBOL_BITS * k for k in range(PER_CHUNK))
    top = sum(1 << SYMBOL_BITS * k + SYMBOL_BITS - 1 for k in range(PER_CHUNK))
    unlike = f"({x}[{chunk}] ^ {y}[{chunk}])"
    return f"bit_count((({unlike} & {low}L) + {low}L | {unlike}) & {top}L)"


def distance(x: str = "lanes", y: str = "p_lanes") -> str:
    """The number of symbols in which two signatures differ, as SQL."""
    return " + ".join(_wrong(c, x, y) for c in range(CHUNKS))


def first_shared() -> str:
    """Whether two signatures that share the key of number `place` share none of a lower number, as SQL.

    A chunk without a wrong symbol shares all its keys, one with one wrong symbol only the key without it.
    """
    before = " and ".join(f"(place < {(c + 1) * PER_CHUNK} or {_wrong(c)} > 1)" for c in range(CHUNKS - 1))
    return f"(place % {PER_CHUNK} = 0 or {_wrong(f'place div {PER_CHUNK}')} = 1) and {before}"


def parity(tokens: np.ndarray) -> np.ndarray:
    """For each of 1024 values of a token's top bits, whether an odd number of the set's tokens has it, as 64-bit numbers.

    Each token that only one of two sets has changes one bit, so the parities differ in no more bits than there
    are such tokens.
    """
    odd = np.bincount((tokens >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _with_parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = np.concatenate([np.empty(0, "<i8"), *(parity(token_set(value.as_py())) for value in batch.column(2))])
        cuts = pa.array(np.arange(batch.num_rows + 1) * PARITY_LANES, pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(cuts, pa.array(each, pa.int64()))], names=["rep", "n", "value", "parity"])


def differing(percent: int) -> str:
    """Whether two sets (n, core of its tokens shared with any other set, their parity) may differ in as few tokens as a link asks, as SQL.

    Of n + p_n = union + intersection tokens, a link's sets differ in (100 - percent) / (100 + percent) at most.
    """
    unlike = " + ".join(f"bit_count(parity[{k}] ^ p_parity[{k}])" for k in range(PARITY_LANES))
    return f"{100 + percent} * (n - core + p_n - p_core + {unlike}) <= {100 - percent} * (n + p_n)"


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2):
                own = shingle_set(text.as_py(), width)
                digest = xxhash.xxh3_128_digest(own.tobytes())
                sign = signature(own) if len(own) else None
                rows.append((len(own), digest, sign, lanes(sign)) if sign else (0, None, None, None))
            counts, digests, signs, numbers = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary()), pa.array(numbers, pa.list_(pa.int64()))],
                names=["_row", "doc_id", "mark", "n_shingles", "digest", "sign", "lanes"],
            )

    return run


def _keys(sign: str = "sign"):
    """All keys of a signature: each chunk without each of its symbols in turn."""
    keys = []
    for c in range(CHUNKS):
        at = c * PER_CHUNK * SYMBOL_BYTES
        for o in range(PER_CHUNK):
            left = F.substring(sign, at + 1, o * SYMBOL_BYTES)
            right = F.substring(sign, at + (o + 1) * SYMBOL_BYTES + 1, (PER_CHUNK - 1 - o) * SYMBOL_BYTES)
            keys.append(F.xxhash64(F.lit(c * PER_CHUNK + o), left, right))
    return F.array(*keys)


def signatures(numbered: DataFrame, ident: str, text: str, width: int) -> DataFrame:
    """(_row, doc_id, hash of the text, n_shingles, digest of the set, sign, lanes) of each row."""
    narrow = numbered.select("_row", F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"))
    return narrow.mapInArrow(_signed(width), "_row long, doc_id long, mark long, n_shingles long, digest binary, sign binary, lanes array<long>")


def link_classes(classes: DataFrame, numbered: DataFrame, text: str, width: int, percent: int) -> DataFrame | None:
    """(node, component) of the classes (rep, n_shingles, sign, lanes) that are linked with others, see linking.linked.

    A bucket holds the classes that share a signature key. A class weighs as much as its buckets hold, so the
    text that a family was made from is its first pivot. Before texts are compared the distance of the
    signatures is. After the first round a pair meets only at the first key that it shares. For the classes that the first round leaves, the frequencies of their shingles among them
    are counted: a set shares no more with any other than the shingles that some other of them has, and these shingles
    are all that later comparisons need. Their parities bound from below in how many two sets differ. Both are exact
    and together exclude nearly all close but unlinked pairs before a pair is made, so also in a large family whose
    members share every change with some other.
    """
    keys = classes.select("rep", F.col("n_shingles").alias("n"), F.posexplode(_keys()).alias("place", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    kept = written(keys.join(shared, "key"))
    weights = kept.groupBy("rep").agg(F.sum("held").alias("weight"))
    seats = written(kept.join(weights, "rep").select("key", "rep", "weight", "n", "place"))
    discard(kept)
    signs = classes.select("rep", "lanes")
    texts = numbered.select(F.col("_row").alias("rep"), F.lit(None).cast("long").alias("n"), F.col(text).alias("value"))
    sizes = f"100 * least(n, p_n) >= {percent} * greatest(n, p_n)"

    def confirm(pairs: DataFrame) -> DataFrame:
        near = pairs.join(signs, "rep").join(signs.select(F.col("rep").alias("pivot"), F.col("lanes").alias("p_lanes")), "pivot")
        close = written(near.filter(f"{distance()} <= {FARTHEST}").select("pivot", "rep"))
        links = confirmed(close, texts, lambda value: shingle_set(value, width), percent)
        discard(close)
        return links

    def later(now: DataFrame):
        left = written(now.select("rep").distinct())
        total = classes.join(left, "rep").agg(F.sum("n_shingles")).first()[0]
        blocks = in_blocks(texts.join(left, "rep").select(F.col("rep").cast("string").cast("binary").alias("id"), F.col("value").alias("text")), total)
        found = shared_shingles(blocks, total, width, percent).filter("tokens is not null").select("id", F.col("n").alias("size"), "tokens")
        named = found.join(left.withColumn("id", F.col("rep").cast("string").cast("binary")), "id").select("rep", F.col("size").alias("n"), F.col("tokens").alias("value"))
        sets = written(named.mapInArrow(_with_parity, "rep long, n long, value binary, parity array<long>"))
        discard(left, blocks)
        more = sets.select("rep", (F.octet_length("value") / 8).cast("long").alias("core"), "parity")
        fits = f"{sizes} and {100 + percent} * least(core, p_core) >= {percent} * (n + p_n) and {distance()} <= {FARTHEST} and {first_shared()} and {differing(percent)}"
        return now.join(more, "rep").join(signs, "rep"), fits, lambda pairs: confirmed(pairs, sets, token_set, percent)

    return linked(seats, sizes, confirm, later, PIVOTS, WIDEN)


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row, see near_rows.

    component_id is the smallest id of the row's group, kept is doc_id = component_id. In a group without any
    id component_id is null and one row is kept. Rows are told apart by a number, not by their id: unrelated
    texts under one id are in groups of their own, and a row without id is in the group of its copies. Null
    and empty texts have no shingles and are linked with nothing; long texts are read whole; an empty table gives no rows; other columns
    are ignored.
    """
    numbered = numbered_rows(docs.select(ident, text))
    kept = F.when(F.col("component_id").isNull(), F.col("_row") == F.col("head")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return near_rows(numbered, ident, text, width, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def numbered_rows(docs: DataFrame) -> DataFrame:
    """docs with a unique `_row`, in buckets of it: the one time that all texts are shuffled."""
    spark = docs.sparkSession
    return bucketed(docs.withColumn("_row", F.monotonically_increasing_id()).repartition(n_partitions(spark), "_row"), "_row")


def near_rows(numbered: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(_row, doc_id, n_shingles, component_id, head) for each row of numbered_rows().

    Rows are linked when 100 x intersection >= percent x union of their shingle sets. Equal sets are one
    class from the start; only one row of a class goes on, so copies never pair. Classes that share a
    signature key are compared on full sets, see link_classes(). head is the _row that stands for the group: the one
    with the smallest id, of these the one with the least hash of the text; rows without id come last.
    component_id is its id.
    """
    signed = written(signatures(numbered, ident, text, width))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", F.col("_row").alias("rep"))
    classes = written(
        signed.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min(F.struct(order.alias("first"), "n_shingles", "sign", "lanes")).alias("x"))
        .select("digest", F.col("x.first.rep").alias("rep"), F.col("x.first").alias("first"), F.col("x.n_shingles").alias("n_shingles"), F.col("x.sign").alias("sign"), F.col("x.lanes").alias("lanes"))
    )
    found = link_classes(classes.select("rep", "n_shingles", "sign", "lanes"), numbered, text, width, percent)
    named = classes.select("digest", "rep", "first")
    if found is not None:
        joined = classes.select("rep", "first").join(found.withColumnRenamed("node", "rep"), "rep")
        best = written(joined.groupBy("component").agg(F.min("first").alias("best")))
        named = named.join(joined.join(best, "component").select("rep", "best"), "rep", "left").select("digest", F.coalesce("best", "first").alias("first"))
    named = written(named.select("digest", F.col("first.doc_id").alias("component_id"), F.col("first.rep").alias("head")))
    labelled = signed.join(named, "digest", "left")
    alone = F.col("digest").isNull()
    return labelled.select(
        "_row",
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("_row")).otherwise(F.col("head")).alias("head"),
    )
