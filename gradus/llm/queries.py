"""The training-data operators as queries over the standard tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, clusters, decontaminate, fingerprint, jaccard, langid, linededup, lmscore, mainhtml, mixing, pii, secrets, warc
from .common import shared_dir, table
from .sql import ORACLES


def _remainder(of: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return mixing.mix(docs, labels.select("doc_id", F.when(F.col("q") > 0, 2.0).otherwise(0.5).alias("weight")))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lmscore.scores(docs, _remainder(7) != 2)
    return found.select("doc_id", (_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, table(spark, sf_dir, "documents"), sf_dir)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.plan(pages), folder, warc.train_dictionary(pages)).agg(F.sum("records")).collect()
    found = warc.read(spark, folder, payloads=False)
    broken = F.raise_error(F.concat(F.lit("broken record: "), "path", F.lit(" "), "error"))
    checked = F.when(F.col("error").isNotNull(), broken).otherwise(F.col("record_type"))
    return found.select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), "refers_to")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_remainder(3) != 1))
    found = langid.predict(docs, model)
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, f"{shared_dir(spark)}/secrets-{uuid.uuid4().hex}")
    return secrets.findings(docs, found=ledger.update(docs))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.replay(audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "mixed"]

QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_mixing, op3_jaccard_join, op4_warc, op5_fingerprint, op6_pii, op7_language_id, op8_decontamination, op9_html_extraction, op10_secret_scan, op11_line_dedup, op12_filter_audit, op13_clustering, pipeline)}
