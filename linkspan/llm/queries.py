"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkspan.llm import align, bpe, langid, packing, pii, quality, simhash, spotsigs, token_count, topk, toxicity, variants, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.digest_rows(_table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"))).drop("passages")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = _table(spark, sf_dir, "documents")
    return pii.digest_rows(docs, pii.train(docs))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in packed sequences."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts of every document."""
    return quality.rules(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    return token_count.count_tokens(_table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors of every query vector."""
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back."""
    return warc.archive(_table(spark, sf_dir, "pages"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens in two tokenizers."""
    return align.digest_rows(_table(spark, sf_dir, "documents"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their most frequent spelling."""
    return variants.variants(_table(spark, sf_dir, "documents"))


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot-signature fingerprints of every document and its edited text."""
    return spotsigs.digest_rows(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_langid, op3_toxicity, op4_pii, op5_packing, op6_quality, op7_bpe, op8_token_count, op9_topk, op10_warc, op11_align, op12_variants, op13_fingerprint)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from linkspan.llm.oracles import ORACLES

    return dict(ORACLES)
