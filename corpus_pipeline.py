"""Training-data pipeline over `documents`: five stages, each written as Parquet and reread.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork import ship
from braidwork.llm.common import hidden, written
from braidwork.llm.decontamination import drop_contaminated
from braidwork.llm.packing import pack
from braidwork.llm.queries import tokenizer_path
from braidwork.llm.simhash import drop_near_duplicates
from braidwork.llm.substrings import repeated_words
from braidwork.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier calls toxic: those of score 0.5 or more.

    Null and empty texts are scored like a text without words, repeated rows
    share their fate.  Empty table: no rows.  Columns may have any names.
    """
    ship(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near-duplicates: five-word Jaccard similarity of 0.8 or more.

    Every row has its group: null, empty and blank texts are equal, repeated
    rows stay once, rows of null id only if their group has no other.  Empty
    table: no rows.  Columns may have any names.
    """
    ship(spark)
    return drop_near_duplicates(docs, words=5, similarity=0.8)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of windows that occur earlier; a changed text has its n_chars set anew.

    Null texts and texts without such words stay as they are, rows that repeat
    an id and a text are not earlier than each other.  Empty table: no rows.
    Columns may have any names.
    """
    ship(spark)
    own, of = hidden(docs)
    rest = tuple(c for c in own.columns if c not in (of("doc_id"), of("text")))
    out = repeated_words(own, id_col=of("doc_id"), text_col=of("text"), result="text", keep=rest)
    if "n_chars" in docs.columns:
        n = of("n_chars")
        out = out.withColumn(n, F.when(F.col("n_removed") > 0, F.char_length(of("text")).cast(own.schema[n].dataType)).otherwise(F.col(n)))
    return out.select(*own.columns).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark.

    Null and empty texts stay, repeated rows share their fate; an empty
    benchmark drops nothing.  Empty table: no rows.  Columns may have any names.
    """
    ship(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids, a row for each piece of a document.

    Null and empty texts are one end id; repeated rows are packed each.  Empty
    table: no rows.  Other columns than doc_id and text are not looked at.
    """
    ship(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_substrings", repeated_substrings),
    ("decontamination", decontamination), ("packing", packing),
]

#: A classifier, components and token ids: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
