"""Connected components of pairs that share a key and prove to be linked, without making all pairs of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, n_partitions, written
from .graph import components

#: Pivots of a key: one in the first round, so many in the second, then so many times more in each.
PIVOTS, WIDEN = 4, 8
#: Sets that are compared with one copy of a pivot's set.
BLOCK = 256
Confirm = Callable[[DataFrame], DataFrame]


def _compare(make: Callable[[object], np.ndarray], percent: int):
    """Rows come by (pivot, block), the pivot's own set first; gives (pivot, row) of each link. Two sets are in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, size = np.empty(0, np.uint64), 0
        for batch in batches:
            out = []
            for pivot, side, ident, n, value in zip(*batch.columns):
                own = make(value.as_py())
                total = len(own) if n.as_py() is None else n.as_py()
                if not side.as_py():
                    lead, size = own, total
                    continue
                common = len(np.intersect1d(lead, own, assume_unique=True))
                if 100 * common >= percent * (size + total - common):
                    out.append((pivot.as_py(), ident.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, make: Callable[[object], np.ndarray], percent: int) -> DataFrame:
    """Those of the pairs (pivot, rep) that are links on full sets, as (u, v).

    sets is (rep, n, value); make gives a value's set, n its size if the set leaves tokens out that no other set has (else
    null). A row's value moves once for each of its pairs; a pivot's once for each block of about 256 of its
    pairs, so no pivot fills a task.
    """
    blocks = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    dealt = pairs.join(blocks, "pivot").select("pivot", F.pmod(F.xxhash64("rep"), "_blocks").alias("block"), "rep")
    sides = dealt.select("pivot", "block", F.lit(1).alias("side"), "rep")
    leads = dealt.select("pivot", "block", F.lit(0).alias("side"), F.col("pivot").alias("rep")).distinct()
    moved = sets.select("rep", "n", "value").join(sides.union(leads), "rep")
    groups = moved.select("pivot", "block", "side", "rep", "n", "value").repartition(n_partitions(sets.sparkSession), "pivot", "block").sortWithinPartitions("pivot", "block", "side")
    return written(groups.select("pivot", "side", "rep", "n", "value").mapInArrow(_compare(make, percent), "u long, v long"))


def token_set(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u8")


def linked(seats: DataFrame, fits: str, confirm: Confirm, later: Callable[[DataFrame], tuple[DataFrame, str, Confirm]] | None = None, pivots_of_key: int = PIVOTS, widen: int = WIDEN) -> DataFrame | None:
    """(node, component) of the reps that are linked with others, None if there is no link.

    seats is (key, rep, weight, ...), a written table that is deleted here; fits is a condition on two seats of a
    key, the pivot's columns named p_...; confirm gives the links among pairs (pivot, rep). A pair of a key is
    settled once it was compared, or fits excludes it, or it lies in one component. Each round compares the
    rows of a key with a pivot, joins links into components, and drops the pivot, whose pairs are all settled;
    a key whose other rows are of one component is done. So a family around one text takes about as many
    comparisons as it has members.

    In the first round the pivot has the greatest weight, which should tell the centre of a family, and a row
    meets one pivot, the weightiest of all its keys. In later rounds the pivots are of the component with the
    greatest id first, hence of late joiners, and their number grows widen-fold a round from pivots_of_key, so that
    rounds end when all pairs of the hardest key that fit are compared. In a key of no more rows than that each is a
    pivot. later is called once, on the seats (key, rep, c, ...) that the first round left, and may give them more
    columns and fewer rows and a sharper condition; the sharper it is, the faster the number of pivots may grow.
    """
    now, found, tried, step = seats, None, None, 0
    while True:
        own = F.coalesce("component", "rep") if found is not None else F.col("rep")
        bare = now.drop("c", "_n")
        labelled = bare.join(found.withColumnRenamed("node", "rep"), "rep", "left") if found is not None else bare
        labelled = labelled.select(*bare.columns, own.alias("c"))
        open_keys = labelled.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count("*").alias("_n")).filter("_lo <> _hi").select("key", "_n")
        last, now = now, written(labelled.join(open_keys, "key"))
        discard(last)
        if step == 1 and later is not None and now.limit(1).count():
            last = now
            now, fits, confirm = later(now)
            now = written(now)
            discard(last)
        largest = now.agg(F.max("_n")).first()[0]
        if largest is None:
            discard(now)
            return found
        ways = pivots_of_key * widen ** (step - 1) if step else 1
        rest = [c for c in now.columns if c not in ("key", "rep", "c", "weight", "_n")]
        order = ["weight", "rep", "c"] if step == 0 else ["c", "weight", "rep"]
        part = F.when(F.col("_n") <= ways, F.col("rep")).otherwise(F.pmod(F.xxhash64("rep", F.lit(step)), F.lit(ways)))
        pivots = now.groupBy("key", part.alias("part")).agg(F.max(F.struct(*order, *rest)).alias("p"))
        pivots = written(pivots.select("key", F.col("p.rep").alias("pivot"), *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("c", "weight", *rest)]))
        met = now.join(pivots, "key").filter(f"c <> p_c and {fits}")
        if step == 0:
            pairs = met.groupBy("rep").agg(F.max(F.struct("p_weight", "pivot")).alias("p")).select("p.pivot", "rep")
        else:
            pairs = met.groupBy(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).agg(F.max("pivot").alias("pivot"))
            pairs = pairs.select("a", "b", "pivot", F.expr("if(pivot = a, b, a)").alias("rep"))
            pairs = pairs.join(tried, ["a", "b"], "left_anti").select("pivot", "rep")
        pairs = written(pairs)
        links = confirm(pairs)
        done = pairs.select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b"))
        tried = done if tried is None else tried.union(done)
        if links.limit(1).count():
            found = written(components(links if found is None else links.union(found.select("node", "component"))))
        if largest <= ways:
            discard(now, pivots, links)
            return found
        if step:
            last, now = now, written(now.join(pivots.select("key", F.col("pivot").alias("rep")), ["key", "rep"], "left_anti"))
            discard(last)
        discard(pivots, links)
        step += 1
