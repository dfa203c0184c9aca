"""The registered queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strideway.llm import alignment, bpe, decontamination, exact_dedup, fill_in_middle, fingerprints, html_extract, language_id, minhash, packing, suffix_dedup, token_counts, warc
from strideway.llm.common import read_table, scratch

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_ids(read_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(read_table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(read_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, which are verified; of revisits only the headers are read."""
    path = scratch(spark, "warc")
    warc.write_warc(read_table(spark, sf_dir, "pages"), path)
    responses = warc.read_warc(spark, path, payload=False, verify=True).where("record_type = 'response'")
    revisits = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    return responses.union(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fim_digests(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [op1_html_extract, op2_language_id, op3_exact_dedup, op4_suffix_dedup, op5_token_counts, op6_fingerprints, op7_bpe, op8_packing, op9_minhash, op10_warc, op11_token_alignment, op12_decontamination, op13_fill_in_middle]
    return {f.__name__: f for f in found}


ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": exact_dedup.ORACLE_SQL, "op4_suffix_dedup": suffix_dedup.ORACLE_SQL, "op12_decontamination": decontamination.ORACLE_SQL, "op13_fill_in_middle": fill_in_middle.ORACLE_SQL}
