"""Queries of the text and key problems, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, packing, pii, seen
from siltstone.session import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seen(spark: SparkSession, sf_dir: str, measure: bool = False):
    rows = settle(seen.keyed_rows(table(spark, sf_dir, "wal_entry"), table(spark, sf_dir, "incoming_key")), "keyed-rows")
    return rows, settle(seen.bloom_answers(rows, seen.absent_keys(rows) if measure else None), "bloom-answers")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incoming rows whose key occurred before."""
    return seen.seen_before(*_seen(spark, sf_dir))


def p3_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong answers of the filters on known absent keys, as many as there are keys, and on the keys that were new."""
    return seen.error_rate(*_seen(spark, sf_dir, measure=True))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.encode(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = bpe.token_counts(table(spark, sf_dir, "documents"))
    return packing.pack(settle(packing.pieces(sized), "pieces"))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container, place and step of every document or piece."""
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are and how even the steps."""
    return packing.fill_report(_packed(spark, sf_dir))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose place breaks a rule, for each rule, with the number of documents that it was checked on."""
    docs = table(spark, sf_dir, "documents")
    sized = settle(bpe.token_counts(docs), "sizes")
    found = packing.violations(sized, packing.pack(settle(packing.pieces(sized), "pieces")))
    checked = F.when(F.col("rule") == "coverage", F.col("n_checked"))
    return found.select("rule", checked.alias("n_documents"), "n_broken")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where personal information stands in the documents."""
    return pii.findings(pii.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_register")))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders in place of personal information."""
    return pii.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_register"), redacted=True).select("doc_id", "text")


SQL = {
    "p7_check": """
SELECT rule, CASE WHEN rule = 'coverage' THEN (SELECT count(DISTINCT doc_id) FROM documents) END AS n_documents, CAST(0 AS BIGINT) AS n_broken
FROM (VALUES ('capacity'), ('contiguity'), ('coverage'), ('whole'), ('numbering')) AS t(rule)""",
    "p3_found": """
SELECT DISTINCT incoming_id FROM incoming_key i WHERE key IS NOT NULL AND (
  key IN (SELECT key FROM wal_entry WHERE key IS NOT NULL)
  OR incoming_id > (SELECT min(incoming_id) FROM incoming_key j WHERE j.key = i.key))""",
}

QUERIES = {f.__name__: f for f in (p3_found, p3_error_rate, p6_ids, p7_packing, p7_fill, p7_check, p8_found, p8_redacted)}
