"""The opN queries: each applies one operator to its whole table and keeps the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .oracles import ORACLES as ORACLES


#: Words of an n-gram of the language model.
ORDER = 3


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary(), limit=1024)


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), order=ORDER)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import page_texts

    return page_texts(table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"), least=20, with_text=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_counts

    return mix_counts(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_copies

    return exact_copies(table(spark, sf_dir, "documents"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"), least_docs=3, top=200)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_decontamination": op2_decontamination,
    "op3_pii": op3_pii,
    "op4_html_text": op4_html_text,
    "op5_fingerprints": op5_fingerprints,
    "op6_substrings": op6_substrings,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_filter_audit": op13_filter_audit,
}
