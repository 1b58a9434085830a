"""Word overlap of two tables of texts, without pairing rows that share nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import long_words


def word_overlaps(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, overlap) of each document and each item that share a word: word_overlap of their texts.

    Both sides are opened to their distinct long words and joined on the word; shared words are counted by a
    number of the row, so rows without id and rows that share one stand for themselves. Where Spark broadcasts
    the items, a document's words stay in its task and are counted before anything is shuffled.
    """

    def opened(df: DataFrame, ident: str, side: str) -> DataFrame:
        rows = df.select(F.monotonically_increasing_id().alias(f"_{side}"), F.col(ident), long_words(text).alias("_words"))
        return rows.select(f"_{side}", ident, F.size("_words").alias(f"_n{side}"), F.explode("_words").alias("_word"))

    pairs = opened(docs, doc, "a").join(opened(items, item, "b"), "_word")
    shared = pairs.groupBy("_a", "_b", doc, item, "_na", "_nb").agg(F.count("*").alias("_both"))
    return shared.select(doc, item, (F.col("_both") / (F.col("_na") + F.col("_nb") - F.col("_both"))).alias("overlap"))
