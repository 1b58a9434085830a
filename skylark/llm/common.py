"""What the operators share: tables in the shared folder, global prefix sums, word patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; set here only where the session names none.

    A local session then takes a temporary folder, any other master its warehouse, which all executors see.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else ""
    if not found:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        base = tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir")
        found = f"{base}/skylark-checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again.

    Cuts the lineage, survives the loss of any executor, and gives the planner true sizes, so that
    it picks broadcast joins only for tables that are small as measured.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() from the shared folder, once nothing that is still to run reads them."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """df written to the shared folder in as many buckets of the keys as a shuffle has partitions; joins on the keys don't move it again.

    Buckets need a table of the catalog; only its files are kept, the catalog entry goes at once.
    """
    spark = df.sparkSession
    name, n = f"buckets_{uuid.uuid4().hex}", n_partitions(spark)
    path = f"{shared_dir(spark)}/tables/{name}"
    df.write.format("parquet").bucketBy(n, *keys).option("path", path).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    table._written_to = path
    spark.sql(f"drop table {name}")
    return table


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_prefix(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, Column]) -> DataFrame:
    """df with, for each name in sums, `<name>_before` and `<name>_total`.

    `before` is the sum over all rows that precede the row in the global order, `total` over all rows.
    One range shuffle puts the rows in order; totals of each partition (one row a partition, so bounded by
    the number of partitions) are summed up and joined back. No task sees more than one partition's rows.
    The order must be total up to rows that are equal in every used column.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    named = df.select("*", *[v.alias(f"_v_{k}") for k, v in sums.items()], *[c.alias(f"_o_{i}") for i, c in enumerate(keys)])
    by = [F.col(f"_o_{i}") for i in range(len(keys))]
    ranged = written(named.repartitionByRange(*by).select("*", F.spark_partition_id().alias("_part")))
    totals = ranged.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    ahead, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = totals.select(
        "_part",
        *[F.coalesce(F.sum(f"_s_{k}").over(ahead), F.sum(f"_s_{k}").over(every) * 0).alias(f"_b_{k}") for k in sums],
        *[F.sum(f"_s_{k}").over(every).alias(f"{k}_total") for k in sums],
    )
    within = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.select("*", *[F.sum(f"_v_{k}").over(within).alias(f"_r_{k}") for k in sums])
    out = summed.join(F.broadcast(offsets), "_part")
    for k in sums:
        out = out.withColumn(f"{k}_before", F.col(f"_b_{k}") + F.col(f"_r_{k}") - F.col(f"_v_{k}"))
    hidden = ["_part", *[f"_o_{i}" for i in range(len(keys))], *[f"_{x}_{k}" for k in sums for x in "vbr"]]
    return out.drop(*hidden)


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
