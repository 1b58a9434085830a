"""N-gram Jaccard join: adaptive multi-match prefixes over word shingles, exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .linking import confirmed, linked, token_set
from .shingles import in_blocks, shared_shingles, words_of


def _digests(texts: bool):
    """(doc_id, n_words, digest) of each row, or (id, text) once for each distinct digest of a task; digests are of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            split = [words_of(text.as_py()) for text in batch.column(1)]
            digests = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in split]
            if not texts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in split], pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "n_words", "digest"])
                continue
            new = []
            for i, d in enumerate(digests):
                if d is not None and d not in seen:
                    seen.add(d)
                    new.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in new], pa.binary()), batch.column(1).take(pa.array(new, pa.int64()))], names=["id", "text"])

    return run


def _prefix(value: bytes, size: int) -> list[int]:
    return np.frombuffer(value, "<i8", size).tolist()


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each set's prefix for its number of matches, as an array."""
    for batch in batches:
        sizes = np.asarray(batch.column(2)) + np.asarray(batch.column(3)) - 1
        rows = [_prefix(v.as_py(), min(int(s), len(v.as_py()) // 8)) for v, s in zip(batch.column(4), sizes)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(rows, pa.list_(pa.int64())), batch.column(5), batch.column(6)], names=["rep", "n", "first", "matches", "prefix", "weight", "own"])


def join_classes(sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, component) of the reps of sets (rep, n, first, matches, weight, tokens), see shared_shingles, that are linked with others.

    Two sets at the similarity share a token of their first prefixes, and k tokens of their prefixes for k
    matches, for any k. So candidates share a first-prefix token, at a place from which enough tokens are left;
    a candidate is verified if the prefixes for each side's own number of matches share the lesser number or more.
    """
    own = F.col("n") - F.octet_length("tokens") / 8
    wide = sets.select("rep", "n", "first", "matches", "tokens", "weight", own.cast("long").alias("own"))
    held = written(wide.mapInArrow(_prefixes, "rep long, n long, first int, matches int, prefix array<long>, weight long, own long"))
    places = held.select("rep", "n", "weight", "own", F.posexplode(F.slice("prefix", F.lit(1), F.col("first"))).alias("at", "key"))
    seats = written(places.select("key", "rep", "weight", "n", (F.col("own") + F.col("at")).alias("before")))
    left = "least(n - before, p_n - p_before)"
    fits = f"100 * least(n, p_n) >= {percent} * greatest(n, p_n) and {100 + percent} * {left} >= {percent} * (n + p_n)"

    def confirm(pairs: DataFrame) -> DataFrame:
        mine = held.select("rep", F.col("prefix").alias("x"), F.col("matches").alias("k"))
        theirs = held.select(F.col("rep").alias("pivot"), F.col("prefix").alias("y"), F.col("matches").alias("p_k"))
        enough = pairs.join(mine, "rep").join(theirs, "pivot").filter("size(array_intersect(x, y)) >= least(k, p_k)")
        kept = written(enough.select("pivot", "rep"))
        links = confirmed(kept, sets.select("rep", "n", F.col("tokens").alias("value")), token_set, percent)
        discard(kept)
        return links

    found = linked(seats, fits, confirm)
    discard(held)
    return found


def similar_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; component_id is the smallest id reachable by links.

    Rows are linked when 100 x intersection >= percent x union of their sets of word shingles, exactly: candidates
    come from prefixes, and are verified on full sets. Equal word sequences are one class from the start,
    folded in each task before they are shuffled. A group without any id has a null component_id. Rows are told apart by
    their sets, not ids: unrelated texts under one id are in groups of their own. Null and empty texts have no
    shingles and are linked with nothing; long texts are read whole; an empty table gives no rows; other columns are ignored.
    """
    narrow = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(narrow.mapInArrow(_digests(False), "doc_id long, n_words long, digest binary"))
    classes = written(signed.filter("n_words > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("n_words").alias("n")))
    total = classes.agg(F.sum("n")).first()[0]
    if total is None:
        return signed.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    blocks = in_blocks(narrow.mapInArrow(_digests(True), "id binary, text string"), total)
    sets = written(shared_shingles(blocks, total, width, percent).withColumn("rep", F.monotonically_increasing_id()))
    discard(blocks)
    found = join_classes(sets.filter("tokens is not null").drop("id"), percent)
    named = sets.select("rep", "n", F.col("id").alias("digest")).join(classes.select("digest", "least"), "digest")
    if found is not None:
        joined = named.join(found.withColumnRenamed("node", "rep"), "rep").select("rep", "component", "least")
        best = joined.groupBy("component").agg(F.min("least").alias("best"))
        named = named.join(joined.join(best, "component").select("rep", "best"), "rep", "left").withColumn("least", F.coalesce("best", "least"))
    named = written(named.select("digest", "n", "least"))
    discard(sets, classes)
    alone = F.col("digest").isNull()
    labelled = signed.join(named, "digest", "left")
    return labelled.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
