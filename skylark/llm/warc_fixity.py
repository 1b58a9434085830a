"""WARC: Merkle fixity audit of archive replicas over records and ordered offset ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_prefix, written

#: Bits of the offset ranges of each level of a tree: 64 KB, then 16 times as many each.
LEVELS = (16, 20, 24, 28, 32)


def warc_record(url: Column, body: Column) -> Column:
    """The bytes of a WARC resource record; a null url or body counts as empty."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def place_records(records: DataFrame, order: Sequence[str], length: str, per_archive: int = 1000) -> DataFrame:
    """records with `archive` (per_archive rows each, in order) and `offset` of each record in its archive.

    Global prefix sums of rows and bytes; nulls first; rows equal in all order columns are interchangeable;
    columns named archive or offset are replaced.
    """
    placed = global_prefix(records.drop("archive", "offset"), [*order, length], {"_n": F.lit(1).cast("long"), "_b": F.col(length).cast("long")})
    placed = placed.withColumn("archive", F.expr(f"_n_before div {per_archive}"))
    first = placed.groupBy("archive").agg(F.min("_b_before").alias("_first"))
    out = placed.join(first, "archive").withColumn("offset", F.col("_b_before") - F.col("_first"))
    return written(out.drop("_first", "_n_before", "_n_total", "_b_before", "_b_total"))


def merkle_tree(records: DataFrame) -> DataFrame:
    """Nodes (level, archive, node, hash) of the trees of a replica given as (archive, offset, length, digest).

    Level 0 are the records: node is the offset, the hash covers offset, length and digest. A node of level i
    covers the records that start in one aligned range of 2^LEVELS[i-1] bytes, by the hashes of its children in
    order; the level above the last is the root, node 0. A range holds few children: 16, or on the first
    level what 64 KB hold. Records that claim one offset are hashed together; an empty replica has no nodes.
    Each level is written once and read for the next.
    """
    leaf = F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256)
    level = records.filter("archive is not null and offset is not null").select("archive", F.col("offset").alias("node"), leaf.alias("hash"))
    level = level.groupBy("archive", "node").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ""), 256).alias("hash"))
    level, bits = written(level), 0
    tree = level.select(F.lit(0).alias("level"), "*")
    for i, b in enumerate((*LEVELS, 62), 1):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        parent = F.shiftright("node", b - bits) if b < 62 else F.lit(0).cast("long")
        above = level.groupBy("archive", parent.alias("up")).agg(children.alias("c"))
        level = written(above.select("archive", F.col("up").alias("node"), F.sha2(F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"], x["hash"])), ","), 256).alias("hash")))
        tree, bits = tree.union(level.select(F.lit(i).alias("level"), "*")), b
    return tree


def damaged_records(left: DataFrame, right: DataFrame) -> DataFrame:
    """(archive, offset, status) of the records in which two trees differ: changed, missing or extra (on the right).

    Roots are compared first; each level down, only children of mismatching nodes are read and compared.
    """
    spans = (0, *LEVELS, 62)
    top = len(spans) - 1

    def differ(level: int, parents: DataFrame | None) -> DataFrame:
        sides = []
        for name, tree in (("l", left), ("r", right)):
            own = tree.filter(F.col("level") == level).select("archive", "node", F.col("hash").alias(name))
            if parents is not None:
                up = F.shiftright("node", spans[level + 1] - spans[level]) if level + 1 < top else F.lit(0).cast("long")
                own = own.withColumn("up", up).join(parents.select("archive", F.col("node").alias("up")), ["archive", "up"], "left_semi").drop("up")
            sides.append(own)
        return written(sides[0].join(sides[1], ["archive", "node"], "full").filter(~F.col("l").eqNullSafe(F.col("r"))))

    found = None
    for level in range(top, -1, -1):
        found = differ(level, found)
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").otherwise("changed")
    return found.select("archive", F.col("node").alias("offset"), status.alias("status"))


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """records (archive, offset, length, digest and any other columns) with `status`, and the replica's extra records.

    status is ok, changed or missing; extra rows have null in all columns but archive, offset and status. A
    column named status is replaced. Records without archive or offset belong to no tree and are ok. Repeated
    records share their offset's status; empty replicas make all records missing, empty records all extra.
    """
    bad = damaged_records(merkle_tree(records), merkle_tree(replica))
    plain = records.drop("status")
    own = plain.join(bad.filter("status <> 'extra'"), ["archive", "offset"], "left").withColumn("status", F.coalesce("status", F.lit("ok")))
    return own.select(*plain.columns, "status").unionByName(bad.filter("status = 'extra'"), allowMissingColumns=True)
