"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from pyspark.sql import functions as F

from nomen.llm import byte_bpe, collocations, decontaminate, license_scan, masked_lm, packing, periodic_runs, pii, quality, repeats, simhash, topk, warc
from nomen.llm._shared import documents, new_path


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the personal data of every document; null texts have no spans, repeated rows a row each."""
    docs = documents(spark, sf_dir)
    return pii.span_digests(docs, pii.train(docs))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and wordless texts have fingerprint zero and are linked like others."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, null and empty texts included; rows of the held-out fold are not learnt from."""
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, documents(spark, sf_dir, "labels")))


def op4_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed log-probability of every document; documents without words have no mean."""
    return masked_lm.score_documents(documents(spark, sf_dir))


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors of each query row; null vectors and such with null or non-finite parts take no part."""
    vectors = topk.quantised(documents(spark, sf_dir, "embeddings"))
    found = topk.top_k(vectors, vectors.where(F.col("id") % 50 == 0), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark windows; null texts have no words."""
    return decontaminate.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 2048 tokens; a null text packs as its end id alone."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated passages; repeated rows are documents of their own."""
    return repeats.remove_repeats(documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document; null texts have none."""
    found = license_scan.scan_licenses(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written and read back; a null page has an empty payload."""
    path = new_path(spark, "warc")
    warc.write_archive(warc.to_records(documents(spark, sf_dir, "pages")), path)
    return warc.archive_report(spark, path)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language; null texts count as empty, and a null language as ``und``."""
    return collocations.collocations(documents(spark, sf_dir))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to; null texts have no ids."""
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document and its text without their repetitions; null texts have no words."""
    return periodic_runs.run_digests(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_simhash": op2_simhash,
        "op3_quality": op3_quality,
        "op4_masked_lm": op4_masked_lm,
        "op5_maxscore": op5_maxscore,
        "op6_decontaminate": op6_decontaminate,
        "op7_packing": op7_packing,
        "op8_repeats": op8_repeats,
        "op9_license_scan": op9_license_scan,
        "op10_warc": op10_warc,
        "op11_collocations": op11_collocations,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_maxscore": topk.ORACLE, "op6_decontaminate": decontaminate.ORACLE, "op8_repeats": repeats.ORACLE, "op10_warc": warc.ORACLE, "op11_collocations": collocations.ORACLE}
