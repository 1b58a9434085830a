"""SentencePiece encoding and decoding: n-best segmentation by forward Viterbi and backward A-star."""

from __future__ import annotations

import heapq
import itertools
import math
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Scores are integers, this many to a nat, so that sums are exact.
UNIT = 1 << 20
_NONE = -(1 << 60)
#: Characters of words that are scored together; longer words are scored one by one.
LONG = 40
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_SLOTS = 20


class Pieces:
    """The pieces of a SentencePiece model file with their ids, integer scores and bytes.

    A unigram model's scores are log probabilities. A BPE model's scores are merge ranks; piece of rank r
    gets -ln(2 + r), as in a Zipf law. A character that is no piece falls back to its UTF-8 byte pieces, each
    10 nats below the least score.
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        normal = [i for i in range(len(sp)) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        raw = {i: sp.get_score(i) for i in normal}
        ranks = any(v < -1000 for v in raw.values())
        order = sorted(normal, key=lambda i: (-raw[i], i))
        value = {i: -math.log(2 + r) for r, i in enumerate(order)} if ranks else raw
        self.score = {sp.id_to_piece(i): (i, round(value[i] * UNIT)) for i in normal}
        self.fallback = min(s for _, s in self.score.values()) - 10 * UNIT
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [b""] * len(sp)
        for piece, (i, _) in self.score.items():
            self.bytes[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        self.longest = max(map(len, self.score))
        inner = any(MARK in p.lstrip(MARK) for p in self.score)
        lines = any("\n" in p for p in self.score)
        #: No piece crosses from one segment to the next, so a text's best paths are made of its segments'.
        pattern = r"(?s).+" if inner else (rf"{MARK}*[^{MARK}]+|{MARK}+" if lines else rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.segment = re.compile(pattern)
        self._table()
        #: The n best of segments seen lately; bounded.
        self.nbest = lru_cache(100_000)(lambda segment, n: segment_nbest(self, segment, n))

    def _table(self) -> None:
        """Open addressing by a polynomial hash of code points, spread over the slots."""
        self.keys = np.zeros(1 << _SLOTS, np.uint64)
        self.vals = np.full(1 << _SLOTS, _NONE, np.int64)
        self.ids = np.full(1 << _SLOTS, -1, np.int32)
        self.probes = 1
        for piece, (i, score) in self.score.items():
            h = 0
            for c in piece:
                h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
            slot, probe = (h * int(_SPREAD) & (2**64 - 1)) >> (64 - _SLOTS), 1
            while self.keys[slot]:
                slot, probe = (slot + 1) & ((1 << _SLOTS) - 1), probe + 1
            self.keys[slot], self.vals[slot], self.ids[slot] = h, score, i
            self.probes = max(self.probes, probe)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of each hashed piece; no score and -1 for others."""
        slot = ((h * _SPREAD) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        hit = self.keys[slot] == h
        score, ident = np.where(hit, self.vals[slot], _NONE), np.where(hit, self.ids[slot], -1)
        left = np.flatnonzero(~hit & (self.keys[slot] != 0))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << _SLOTS) - 1)
            got = self.keys[slot[left]]
            good = left[got == h[left]]
            score[good], ident[good] = self.vals[slot[good]], self.ids[slot[good]]
            left = left[(got != h[left]) & (got != 0)]
        return score, ident

    def edges(self, segment: str, end: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(start, score, ids) of the pieces that end at a place."""
        for start in range(max(0, end - self.longest), end):
            found = self.score.get(segment[start:end])
            if found:
                yield start, found[1], (found[0],)
            elif end - start == 1:
                raw = segment[start:end].replace(MARK, " ").encode("utf-8", "surrogatepass")
                yield start, self.fallback * len(raw), tuple(self.byte_ids[b] for b in raw)

    def edge_arrays(self, segment: str, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, score, id) of all edges of the lattice, by end; id is -1 for the bytes of one character.

        One pass a piece length over blocks of starts, so that memory follows the edges found.
        """
        codes = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(codes), block):
            h = np.zeros(min(block, len(codes) - at), np.uint64)
            for length in range(1, min(self.longest, len(codes) - at) + 1):
                h = h[: len(codes) - at - length + 1]
                h = h * _BASE + codes[at + length - 1 : at + length - 1 + len(h)] + np.uint64(1)
                score, ident = self.lookup(h)
                if length == 1:
                    own = codes[at : at + len(h)]
                    size = np.where((own < 128) | (own == ord(MARK)), 1, np.where(own < 2048, 2, np.where(own < 65536, 3, 4)))
                    score = np.where(ident < 0, self.fallback * size, score)
                hit = np.flatnonzero(score > _NONE)
                found.append((hit + at, hit + at + length, score[hit], ident[hit]))
        start, end, score, ident = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, end))
        return start[order], end[order], score[order], ident[order]

    def ids_of(self, segment: str, start: int, ident: int) -> tuple[int, ...]:
        """The ids of an edge of edge_arrays."""
        return (ident,) if ident >= 0 else tuple(self.byte_ids[b] for b in segment[start].replace(MARK, " ").encode("utf-8", "surrogatepass"))


def backward_astar(n_nodes: int, edges_into, alpha: Sequence[int], n: int) -> list[tuple[int, tuple]]:
    """The n best paths from node 0 to the last, best first: (score, labels from left to right).

    alpha[v] is the best score from 0 to v, so alpha[v] + score of the suffix is exact and the heap pops
    complete paths in order. Of equal scores the one pushed last comes first: a path that is begun is finished
    before its ties are looked at, so n paths take at most n x (pieces of the longest) pops.
    """
    order = itertools.count(0, -1)
    heap = [(-alpha[n_nodes - 1], next(order), n_nodes - 1, 0, ())]
    found = []
    while heap and len(found) < n:
        _, _, node, suffix, labels = heapq.heappop(heap)
        if node == 0:
            found.append((suffix, labels))
            continue
        for start, score, label in edges_into(node):
            if alpha[start] > _NONE:
                heapq.heappush(heap, (-(alpha[start] + score + suffix), next(order), start, suffix + score, (label, labels)))
    return [(s, _unlink(labels)) for s, labels in found]


def _unlink(labels: tuple) -> tuple:
    out = []
    while labels:
        out.append(labels[0])
        labels = labels[1]
    return tuple(out)


def _forward(n: int, start: list[int], end: list[int], score: list[int]) -> tuple[list[int], list[int]]:
    """Best score from 0 to each node, and the edge by which it comes; edges by end."""
    alpha, back = [0] + [_NONE] * n, [-1] * (n + 1)
    for i, (s, e, x) in enumerate(zip(start, end, score)):
        x += alpha[s]
        if x > alpha[e]:
            alpha[e], back[e] = x, i
    return alpha, back


def segment_nbest(pieces: Pieces, segment: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
    """(score, ids) of the n best segmentations of one segment (or of any text)."""
    start, end, score, ident = (x.tolist() for x in pieces.edge_arrays(segment))
    alpha, _ = _forward(len(segment), start, end, score)
    first = np.searchsorted(np.array(end), np.arange(len(segment) + 2)).tolist()
    into = lambda v: ((start[i], score[i], (start[i], ident[i])) for i in range(first[v], first[v + 1]))
    paths = backward_astar(len(segment) + 1, into, alpha, n)
    return [(s, tuple(itertools.chain.from_iterable(pieces.ids_of(segment, *own) for own in labels))) for s, labels in paths]


def segment_best(pieces: Pieces, segment: str) -> tuple[int, tuple[int, ...]]:
    """(score, ids) of the best segmentation of one segment: forward Viterbi, then backward A-star.

    Of ties the longest last piece comes first, as in Scored: the edges into a node are pushed by falling start.
    """
    if len(segment) > LONG:
        start, end, score, ident = (x.tolist() for x in pieces.edge_arrays(segment))
        alpha, _ = _forward(len(segment), start, end, score)
        first = np.searchsorted(np.array(end), np.arange(len(segment) + 2)).tolist()
        into = lambda v: ((start[i], score[i], (start[i], ident[i])) for i in range(first[v + 1] - 1, first[v] - 1, -1))
        total, labels = backward_astar(len(segment) + 1, into, alpha, 1)[0]
        return total, tuple(itertools.chain.from_iterable(pieces.ids_of(segment, *own) for own in labels))
    edges, alpha, known, longest = [[]], [0], pieces.score.get, pieces.longest
    for end in range(1, len(segment) + 1):
        into_end, most = [], _NONE
        for start in range(end - 1, max(0, end - longest) - 1, -1):
            found = known(segment[start:end])
            if found:
                into_end.append((start, found[1], found[:1]))
            elif start == end - 1:
                into_end += [(start, x, ids) for _, x, ids in pieces.edges(segment[start:end], 1)]
            else:
                continue
            most = max(most, alpha[start] + into_end[-1][1])
        edges.append(into_end)
        alpha.append(most)
    total, labels = backward_astar(len(segment) + 1, edges.__getitem__, alpha, 1)[0]
    return total, tuple(itertools.chain.from_iterable(labels))


class Best:
    """Best ids and best score for each of a list of distinct segments, by backward A-star over each one's lattice."""

    def __init__(self, pieces: Pieces, segments: list[str]) -> None:
        found = [segment_best(pieces, s) for s in segments]
        self.best = np.array([score for score, _ in found], np.int64)
        self.count = np.array([len(ids) for _, ids in found], np.int64)
        self.ids = np.fromiter(itertools.chain.from_iterable(ids for _, ids in found), np.int32)
        self.start = np.cumsum(self.count) - self.count


class Scored:
    """Best ids, best score and loss of the second best path for each of a list of distinct segments."""

    def __init__(self, pieces: Pieces, segments: list[str]) -> None:
        n = len(segments)
        self.best, self.loss = np.zeros(n, np.int64), np.full(n, -_NONE, np.int64)
        lengths = np.array([len(s) for s in segments], np.int64)
        chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # segment, order in it, id
        for length in np.unique(lengths):
            group = np.flatnonzero(lengths == length)
            step = max(1, 400_000 // int(length * min(length, pieces.longest)))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                if length > LONG:
                    chunks += [self._one(pieces, segments[i], i) for i in part]
                else:
                    chunks.append(self._many(pieces, segments, part, int(length)))
        seg, pos, ident = (np.concatenate(x) for x in zip(*chunks)) if chunks else (np.empty(0, np.int64),) * 3
        order = np.lexsort((pos, seg))
        self.ids = ident[order].astype(np.int32)
        self.count = np.bincount(seg, minlength=n)
        self.start = np.concatenate(([0], np.cumsum(self.count)[:-1]))

    def _one(self, pieces: Pieces, segment: str, i: int):
        """Forward and backward scores over all edges; time and memory follow their number."""
        n = len(segment)
        start, end, score, ident = pieces.edge_arrays(segment)
        s, e, x = start.tolist(), end.tolist(), score.tolist()
        alpha, back = _forward(n, s, e, x)
        beta = [_NONE] * n + [0]
        for k in range(len(s) - 1, -1, -1):
            beta[s[k]] = max(beta[s[k]], x[k] + beta[e[k]])
        path, at = [], n
        while at:
            path.append(back[at])
            at = s[back[at]]
        through = np.array(alpha)[start] + score + np.array(beta)[end]
        through[path] = _NONE
        self.best[i], second = alpha[n], int(through.max())
        if second > _NONE // 2:
            self.loss[i] = alpha[n] - second
        ids = np.array([k for p in reversed(path) for k in pieces.ids_of(segment, s[p], int(ident[p]))], np.int64)
        return np.full(len(ids), i), np.arange(len(ids)), ids

    def _many(self, pieces: Pieces, segments: list[str], part: np.ndarray, n: int):
        w = len(part)
        raw = "".join([segments[i] for i in part]).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, "<u4").reshape(w, n).astype(np.uint64)
        score: dict[tuple[int, int], np.ndarray] = {}
        ident: dict[tuple[int, int], np.ndarray] = {}
        size = np.where(codes < 128, 1, np.where(codes < 2048, 2, np.where((codes < 65536), 3, 4))).astype(np.int64)
        size[codes == ord(MARK)] = 1
        for s in range(n):
            h = np.zeros(w, np.uint64)
            for e in range(s + 1, min(n, s + pieces.longest) + 1):
                h = h * _BASE + codes[:, e - 1] + np.uint64(1)
                sc, ids = pieces.lookup(h)
                if e == s + 1:
                    sc = np.where(ids < 0, pieces.fallback * size[:, s], sc)
                if e == s + 1 or sc.max() > _NONE:
                    score[s, e], ident[s, e] = sc, ids
        alpha, beta = np.full((n + 1, w), _NONE, np.int64), np.full((n + 1, w), _NONE, np.int64)
        back = np.zeros((n + 1, w), np.int64)
        alpha[0], beta[n] = 0, 0
        for e in range(1, n + 1):
            for s in range(max(0, e - pieces.longest), e):
                if (s, e) in score:
                    x = np.maximum(alpha[s] + score[s, e], _NONE)
                    better = x > alpha[e]
                    alpha[e] = np.where(better, x, alpha[e])
                    back[e] = np.where(better, s, back[e])
        for s in range(n - 1, -1, -1):
            for e in range(s + 1, min(n, s + pieces.longest) + 1):
                if (s, e) in score:
                    beta[s] = np.maximum(beta[s], np.maximum(score[s, e] + beta[e], _NONE))
        on = np.zeros((n + 1, n + 1, w), bool)
        at, rows = np.full(w, n), np.arange(w)
        while (go := np.flatnonzero(at > 0)).size:
            s = back[at[go], rows[go]]
            on[s, at[go], go] = True
            at[go] = s
        second = np.full(w, _NONE, np.int64)
        seg, pos, got = [], [], []
        for (s, e), sc in score.items():
            used = on[s, e]
            second = np.maximum(second, np.where(used, _NONE, np.maximum(alpha[s] + sc + beta[e], _NONE)))
            hit = np.flatnonzero(used & (ident[s, e] >= 0))
            seg.append(part[hit])
            pos.append(np.full(len(hit), s * 4))
            got.append(ident[s, e][hit].astype(np.int64))
            for i in np.flatnonzero(used & (ident[s, e] < 0)):
                raw = segments[part[i]][s:e].replace(MARK, " ").encode("utf-8", "surrogatepass")
                seg.append(np.full(len(raw), part[i]))
                pos.append(s * 4 + np.arange(len(raw)))
                got.append(np.array([pieces.byte_ids[b] for b in raw], np.int64))
        self.best[part] = alpha[n]
        self.loss[part] = np.where(second > _NONE // 2, alpha[n] - second, -_NONE)
        return np.concatenate(seg), np.concatenate(pos), np.concatenate(got)


def text_nbest(pieces: Pieces, scored: Scored | Best, segments: list[str], where: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(score, ids) of the n best segmentations of a text whose i-th segment is segments[where[i]].

    Only the n - 1 segments with the least loss can differ from their best path in the n best of the text:
    n - 1 single changes of at most that loss exist already. A-star runs over the chain of these. The best path of
    a text is made of its segments' best paths, which A-star found (Best), so n = 1 has no chain to search.
    """
    count = scored.count[where]
    ends = np.cumsum(count)
    begin = ends - count
    ids = scored.ids[np.repeat(scored.start[where] - begin, count) + np.arange(int(ends[-1]) if len(ends) else 0)]
    total = int(scored.best[where].sum())
    if n == 1 or not len(where):
        return [(total, ids)]
    loss = scored.loss[where]
    few = np.argpartition(loss, n - 2)[: n - 1] if len(loss) > n - 1 else np.arange(len(loss))
    limit = loss[few].max()
    few = np.concatenate((np.flatnonzero(loss < limit), np.flatnonzero(loss == limit)))[: n - 1]  # ties: the leftmost
    few = np.sort(few[loss[few] < -_NONE])
    options = []
    for i in few:  # of tied best paths the scored one comes first
        mine = tuple(ids[begin[i] : ends[i]].tolist())
        own = pieces.nbest(segments[where[i]], n)
        options.append([(own[0][0], mine), *[p for p in own if p[1] != mine][: n - 1]])
    into = [()] + [[(k, score - own[0][0], alt) for alt, (score, _) in reversed([*enumerate(own)])] for k, own in enumerate(options)]
    paths = backward_astar(len(few) + 1, into.__getitem__, [0] * (len(few) + 1), n)
    out = []
    for change, alts in paths:
        parts, last = [], 0
        for i, own, alt in zip(few, options, alts):
            if alt:
                parts += [ids[last : begin[i]], np.array(own[alt][1], np.int32)]
                last = ends[i]
        out.append((total + change, np.concatenate([*parts, ids[last:]])))
    return out


def decode(pieces: Pieces, ids: Sequence[int]) -> str:
    """The text of a sequence of ids, without the space that encoding puts before it."""
    table = pieces.bytes
    return b"".join([table[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def encode_batch(pieces: Pieces, texts: list[str | None], n: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The n best of each text, in order; an empty or null text has one segmentation, of no pieces."""
    index: dict[str, int] = {}
    rows = []
    for text in texts:
        found = pieces.segment.findall(MARK + text.replace(" ", MARK)) if text else []
        rows.append(np.array([index.setdefault(s, len(index)) for s in found], np.int64))
    segments = list(index)
    scored = Best(pieces, segments) if n == 1 else Scored(pieces, segments)
    for where in rows:
        yield text_nbest(pieces, scored, segments, where, n)


def _groups(column: pa.Array, chars: int = 6_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Neighbouring texts of about so many characters together."""
    held, size, start = [], 0, 0
    for i, text in enumerate(column):
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= chars:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


def _model(df: DataFrame, path: str):
    """The model's bytes, read once by the driver (about 1 MB), on every executor."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


@lru_cache(2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def nbest_digests(df: DataFrame, model_path: str, n: int = 4, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pieces, score, nbest_scores, nbest_crc32, decoded_equal) for each row, over its whole text.

    n_pieces and score (nats) are the best segmentation's; the arrays have up to n entries, best first, the
    CRC32 of the ids as 32-bit little-endian numbers; decoded_equal says that decoding the best ids gives
    the text again (a text with U+2581 decodes to a space there). Null and empty texts have no pieces, score
    0 and one segmentation. Of tied segmentations any may come first. Long texts and long words without spaces are
    encoded whole, in time and memory that follow their length. Repeated rows are encoded each; an empty table
    gives no rows; other columns are ignored.
    """
    model = _model(df, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model.value)
        for batch in batches:
            for start, texts in _groups(batch.column(1)):
                out = []
                for t, paths in zip(texts, encode_batch(pieces, texts, n)):
                    crcs = [zlib.crc32(ids.astype("<i4").tobytes()) for _, ids in paths]
                    same = decode(pieces, paths[0][1].tolist()) == (t or "")
                    out.append((len(paths[0][1]), paths[0][0] / UNIT, [s / UNIT for s, _ in paths], crcs, same))
                types = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_()]
                cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), *cols],
                    names=["doc_id", "n_pieces", "score", "nbest_scores", "nbest_crc32", "decoded_equal"],
                )

    fields = "doc_id long, n_pieces long, score double, nbest_scores array<double>, nbest_crc32 array<long>, decoded_equal boolean"
    return df.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, fields)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    """Lists of ids as one array."""
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    flat = np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encode(df: DataFrame, model_path: str, ident: str = "doc_id", text: str = "text", n: int = 1) -> DataFrame:
    """(doc_id, n_pieces, score, ids) for each row; with n > 1 also `others`, the ids of the next best.

    Edge cases as in nbest_digests.
    """
    model = _model(df, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model.value)
        for batch in batches:
            for start, texts in _groups(batch.column(1)):
                got = list(encode_batch(pieces, texts, n))
                best = _lists([p[0][1] for p in got])
                cols = [batch.column(0).slice(start, len(texts)), pa.array([len(p[0][1]) for p in got], pa.int64()), pa.array([p[0][0] / UNIT for p in got], pa.float64()), best]
                names = ["doc_id", "n_pieces", "score", "ids"]
                if n > 1:
                    others = _lists([ids for p in got for _, ids in p[1:]])
                    ends = np.concatenate(([0], np.cumsum([len(p) - 1 for p in got])))
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), others))
                    names.append("others")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    fields = "doc_id long, n_pieces long, score double, ids array<int>" + (", others array<array<int>>" if n > 1 else "")
    return df.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, fields)
