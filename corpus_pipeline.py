"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's `docs`.  All but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import decontaminate, jaccard, langid, secrets
from gradus.llm.common import cut, dropped, shared_dir, small, table
from gradus.llm.queries import mixed
from gradus.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with a key for each doc_id, null included, and text, null included.

    Rows equal in both share a key, and all that is decided for them; the key is a 64-bit hash.
    """
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key"))


def _by_key(docs: DataFrame) -> DataFrame:
    """key (as doc_id) and text, for operators that decide by doc_id."""
    return _keyed(docs).select(F.col("key").alias("doc_id"), "text")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is not among `keys` (doc_id); where these are few, no text is shuffled."""
    keys = small(cut(keys.select(F.col("doc_id").alias("key")).distinct()))
    return _keyed(docs).join(keys, "key", "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that no language's model accepts; `lang` becomes the predicted one.

    Each row is judged where it is read, by its own text: rows without doc_id too, and rows
    that share one apart.  Rows without text are not accepted.  No rows give no rows.
    """
    found = langid.judged(docs.select(*COLUMNS), langid.train(docs)).where("not rejected")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of alike texts: that with the smallest doc_id.

    Rows without doc_id come last; among rows with the same doc_id the smallest key stays.
    Rows equal in doc_id and text, null included, are one document even without shingles;
    of those the smallest in the other columns stays.  No rows give no rows.
    """
    ship(spark)
    groups = jaccard.components(_by_key(docs)).groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    groups = cut(groups)
    # Only groups of several documents need their ids.
    several = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
    crowd = cut(groups.join(small(cut(several.select("component_id"))), "component_id", "left_semi").select("key", "component_id"))
    ids = _keyed(docs).select("key", "doc_id").join(small(crowd), "key").distinct()
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")).select("component_id", "first.key")
    copies = crowd.join(first, ["component_id", "key"], "left_anti")
    kept = _without(docs, copies.select(F.col("key").alias("doc_id")))
    repeated = small(cut(groups.where("rows > 1").select("key")))
    once = kept.join(repeated, "key", "left_anti").select(*COLUMNS)
    return once.union(kept.join(repeated, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose own text holds a window of a benchmark item, with or without doc_id.

    Rows without text, and all rows if there are no items, stay.
    """
    found = decontaminate.occurrences(_by_key(docs), table(spark, sf_dir, "benchmark"))
    return _without(docs, found).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows in whose own text a secret is found, with or without doc_id; rows without text stay."""
    return _without(docs, secrets.findings(_by_key(docs)).where("spans <> ''")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of what is left: a row for each row."""
    return mixed(spark, docs, sf_dir)


STAGES = [
    ("language_id", lambda spark, docs, sf_dir: language(ship(spark), docs, sf_dir)),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to and read from the shared folder.

    What a stage read is removed when the next one's input is written; the last one's input
    stays for those who read the result.
    """
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{i}-{name}")
            docs = spark.read.parquet(f"{at}/{i}-{name}")
            if i:
                dropped(spark, f"{at}/{i - 1}-{STAGES[i - 1][0]}")
    return docs


#: Not SQL: the first two stages learn a model and find components.
ORACLE_SQL = None
