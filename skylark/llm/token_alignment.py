"""Cross-tokenizer alignment: distinct chunks are tokenised and aligned in numpy and Arrow; Spark builds the documents, the corpus-wide counts and the best links."""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Characters of text that share one list of distinct chunks; a longer text has a list of its own.
BUNDLE = 4_000_000
#: Linked id pairs up to which their counts are broadcast (some 100 MB as Spark holds them); beyond, they are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
_BUNDLES = "aligned array<struct<groups string, links array<long>>>, docs array<struct<doc_id long, n_a long, n_b long, n_groups long, at array<int>>>"


class _Tokens:
    """A vocabulary: encode gives a list of token ids for each text of a list, contents are the tokens' bytes; so many plain chunks are encoded together."""

    def __init__(self, encode, contents: list[bytes], together: int) -> None:
        self.encode, self.contents, self.together = encode, contents, together
        self.lengths = np.array([len(b) for b in contents], np.int64)

    def _same(self, ids: list[int], chunk: str) -> bool:
        return b"".join(map(self.contents.__getitem__, ids)) == chunk.encode("utf-8", "surrogatepass")

    def _joined(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of tokens of each chunk) of stretches of plain chunks, each encoded as one text; -1 for a chunk whose tokens' bytes are not its own."""
        cut = [chunks[at : at + self.together] for at in range(0, len(chunks), self.together)]
        texts = ["".join(some) for some in cut]
        sizes = pc.binary_length(pa.array(chunks, pa.string())).to_numpy()
        out = []
        for at, some, text, ids in zip(range(0, len(chunks), self.together), cut, texts, self.encode(texts)):
            if self._same(ids, text):
                found = np.array(ids, np.int32)
                ends = np.cumsum(sizes[at : at + len(some)], dtype=np.int64)
                token_ends = np.cumsum(self.lengths[found])
                spots = np.searchsorted(token_ends, ends)
                if (token_ends[spots] == ends).all():
                    out.append((found, np.diff(spots + 1, prepend=0)))
                    continue
            out.extend(self._single(some))
        return out

    def _single(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        every = [ids if self._same(ids, chunk) else None for chunk, ids in zip(chunks, self.encode(chunks))]
        ids = np.fromiter(itertools.chain.from_iterable(x or () for x in every), np.int32)
        return [(ids, np.array([-1 if x is None else len(x) for x in every], np.int64))]

    def of(self, plain: list[str], odd: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all chunks, and how many each has."""
        found = [*self._joined(plain), *self._single(odd)]
        return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])


class _Places(dict):
    """Numbers chunks as they come."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


def _bytes_of_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable bytes for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(2)
def _byte_level(model: bytes) -> _Tokens:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model.decode())
    tokenizer.encode_special_tokens = True
    letters, vocabulary = _bytes_of_letters(), json.loads(model)["model"]["vocab"]
    contents = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        contents[i] = bytes(letters[c] for c in entry)
    return _Tokens(lambda chunks: [x.ids for x in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)], contents, 500)


@lru_cache(2)
def _pieces(model: bytes) -> _Tokens:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    contents = [sp.id_to_piece(i).replace("▁", " ").encode() for i in range(len(sp))]
    for i in filter(sp.is_byte, range(len(sp))):
        contents[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
    mark = [sp.piece_to_id("▁")]
    # The model puts a space before what it encodes; of a lone space it would make nothing.
    return _Tokens(lambda chunks: [ids if c != " " else mark for c, ids in zip(chunks, sp.encode([c[1:] for c in chunks], num_threads=1))], contents, 200)


def _chunks(text: str) -> list[str]:
    """space+text cut before spaces, where no token of either kind goes on.

    Neither vocabulary has a space after another character. A run of spaces is cut only where no white space
    stands before it, as the byte-level pattern looks ahead in white space.
    """
    if "  " not in text and not text.startswith(" "):
        return [" " + c for c in text.split(" ")]
    return re.split(r"(?<=\S)(?= )", " " + text)


def _plain(chunk: str) -> bool:
    """Whether a chunk's tokens are the same between other chunks of this kind as alone: no white space but its first space at its ends."""
    return len(chunk) > 1 and not chunk[1].isspace() and not chunk[-1].isspace()


def _decimals(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The ids from each start to the next, as decimals with commas between."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pc.cast(pa.array(ids), pa.string())), ",")


def _aligned(ids: list[np.ndarray], counts: list[np.ndarray], kinds: tuple[_Tokens, _Tokens]) -> tuple[pa.StructArray, np.ndarray]:
    """(groups, links) of each chunk, and how many groups it has; ids of all chunks' tokens of both kinds in order, and their number in each chunk.

    Both kinds' tokens have the same bytes in every chunk, so offsets may run on over all chunks, and every chunk ends
    with a cut. Between two ends that follow one another, of either kind, lies the overlap of just one pair.
    """
    ends = [np.cumsum(kind.lengths[x]) for kind, x in zip(kinds, ids)]
    chunk_ends = ends[0][np.cumsum(counts[0]) - 1]
    merged = np.sort(np.concatenate(ends), kind="stable")
    new = np.ones(len(merged), bool)
    new[1:] = merged[1:] != merged[:-1]
    every, cuts = merged[new], merged[~new]
    a, b = (x[np.searchsorted(e, every)].astype(np.int64) for x, e in zip(ids, ends))
    till = lambda where, at: pa.array(np.concatenate(([0], np.searchsorted(where, at, "right"))), pa.int32())
    links = pa.ListArray.from_arrays(till(every, chunk_ends), pa.array((a << 32) + b))
    said = pc.binary_join_element_wise(*(_decimals(x, till(e, cuts)) for x, e in zip(ids, ends)), "|")
    of_chunks = till(cuts, chunk_ends)
    groups = pc.binary_join(pa.ListArray.from_arrays(of_chunks, said), ";")
    return pa.StructArray.from_arrays([groups, links], ["groups", "links"]), np.diff(of_chunks.to_numpy())


def _bundle(idents: pa.Array, texts: list[str | None], kinds: tuple[_Tokens, _Tokens]) -> pa.RecordBatch:
    places = _Places()
    seen = [np.fromiter(map(places.__getitem__, chunks), np.int64, len(chunks)) for chunks in (_chunks(text) if text else [] for text in texts)]
    plain = np.fromiter(map(_plain, places), bool, len(places))
    order = np.argsort(~plain, kind="stable")
    listed, n_plain = list(places), int(plain.sum())
    listed = [listed[i] for i in order]
    found = [kind.of(listed[:n_plain], listed[n_plain:]) for kind in kinds]
    good = (found[0][1] >= 0) & (found[1][1] >= 0)
    ids = [x[np.repeat(good[n >= 0], n[n >= 0])] for x, n in found]
    counts = [n[good] for _, n in found]
    aligned, n_groups = _aligned(ids, counts, kinds)
    number = np.empty(len(order), np.int64)
    number[order] = np.where(good, np.cumsum(good) - 1, -1)
    rows = [number[at].astype(np.int32) for at in seen]
    rows = [at if (at >= 0).all() else at[:0] for at in rows]
    at = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([*rows, np.empty(0, np.int32)])))
    totals = [pa.array([int(n[at].sum()) for at in rows], pa.int64()) for n in (*counts, n_groups)]
    docs = pa.StructArray.from_arrays([idents, *totals, at], ["doc_id", "n_a", "n_b", "n_groups", "at"])
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([one(aligned), one(docs)], names=["aligned", "docs"])


def align(df: DataFrame, byte_model: str, piece_model: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(aligned, docs): bundles of documents, the groups and links of their distinct chunks, and of each document its numbers and the places of its chunks.

    A chunk is a stretch of space+text that no token of either kind leaves, a word with its space. A is a byte-level BPE
    (a tokenizers JSON file), B a SentencePiece model; strings of special tokens are plain text. The offsets where tokens
    of both kinds end cut them into groups, written as "a1,a2|b1;a3|b2" in order. links are the pairs of token
    occurrences whose byte ranges overlap, in text order, each as a's id * 2^32 + b's. A document's groups and links are
    those of its chunks in order.

    Null and empty texts, and texts whose joined token bytes differ from space+text (U+2581 reads as a space, say) have no
    chunks. Long texts and words are encoded whole; repeated rows each; an empty table gives no rows; other columns are
    ignored. The files (a few MB) are read by the driver.
    """
    models, most = [], BUNDLE
    for path in (byte_model, piece_model):
        with open(path, "rb") as f:
            models.append(df.sparkSession.sparkContext.broadcast(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _byte_level(models[0].value), _pieces(models[1].value)
        for batch in batches:
            held, size, start = [], 0, 0
            for i, value in enumerate(batch.column(1)):
                held.append(value.as_py())
                size += len(held[-1] or "")
                if size >= most or i + 1 == batch.num_rows:
                    yield _bundle(batch.column(0).slice(start, len(held)), held, kinds)
                    held, size, start = [], 0, i + 1

    return df.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _BUNDLES)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _place(v: Column) -> Column:
    return v.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def _gathered(values: Column, at: Column) -> Column:
    """The chunks' values at the places of a document. values must be a column or a bound variable, else each place computes it anew."""
    return F.transform(at, lambda i: F.get(values, i))


def alignments(df: DataFrame, byte_model: str, piece_model: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, groups, links) of each row: groups as text, links as an array of (a, b), see align."""
    split = lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("a"), _place(x).alias("b"))
    links = lambda d, all_links: F.transform(F.flatten(_gathered(all_links, d["at"])), split)
    one = lambda d, said, all_links: F.struct(d["doc_id"], d["n_a"], d["n_b"], F.array_join(_gathered(said, d["at"]), ";").alias("groups"), links(d, all_links).alias("links"))
    docs = _let(F.col("aligned.groups"), lambda said: _let(F.col("aligned.links"), lambda all_links: F.transform("docs", lambda d: one(d, said, all_links))))
    return align(df, byte_model, piece_model, ident, text).select(F.inline(docs))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): in how many rows each linked id pair stands, and whether no pair of its A id stands in more."""
    kept = written(rows.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("count")))
    a = F.shiftright("pair", 32)
    most = kept.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return kept.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_digests(df: DataFrame, byte_model: str, piece_model: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row, see align.

    n_best counts the links whose pair's count is the highest of its A id, ties included; count_sum adds the
    counts of all links. Without tokens all are 0 and groups_sha256 is ''. Aligned documents are written once; the
    number of distinct pairs decides whether their counts are broadcast or shuffled.
    """

    def doc(d: Column, said: Column, links: Column) -> Column:
        digest = F.when(F.size(d["at"]) > 0, F.sha2(F.array_join(_gathered(said, d["at"]), ";").cast("binary"), 256)).otherwise("")
        return F.struct(d["doc_id"], d["n_a"], d["n_b"], d["n_groups"], digest.alias("groups_sha256"), F.flatten(_gathered(links, d["at"])).alias("links"))

    docs = _let(F.col("aligned.groups"), lambda said: _let(F.col("aligned.links"), lambda links: F.transform("docs", lambda d: doc(d, said, links))))
    rows = written(align(df, byte_model, piece_model, ident, text).select(F.inline(docs)).withColumn("_row", F.monotonically_increasing_id()))
    counts = written(pair_counts(rows))
    small = counts.count() <= BROADCAST_PAIRS
    counted = rows.select("_row", F.explode("links").alias("pair")).join(F.broadcast(counts) if small else counts, "pair")
    sums = written(counted.groupBy("_row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum")))
    discard(counts)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    n_links = (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links")
    return rows.drop("links").join(sums, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", n_links, zero("n_best"), zero("count_sum"), "groups_sha256")
