"""The registered queries of this subpackage: thin applications of the operators
to their whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import classify, conversations, decontaminate, exact, htmltext, licenses, linededup, oracles, resample, sentencepiece_fst, simhash, substrings, suffixes
from tessera.llm.frames import table

#: A public tokenizer's model file; a parameter of the operator.
MODEL_PATH = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _classified(spark: SparkSession, sf_dir: str, label: str, task: classify.Task, modulus: int, remainder: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", label)
    out = classify.held_out("doc_id", modulus, remainder)
    model = classify.train(docs, labels, label, task, keep=~out)
    return classify.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "toxic", classify.TOXICITY, 3, 1)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "quality", classify.QUALITY, 4, 2)


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    """ids of every whole text, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_fst.encode(docs, model_path, check=True).select("doc_id", "n_tokens", "ids", "round_trip")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("n_chars")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_licenses": op3_licenses,
    "op4_html": op4_html,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_resampling": op12_resampling,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_licenses": licenses.sql(),
    "op5_suffix_dedup": oracles.repeated_strings(),
    "op9_simhash": oracles.near_duplicates(),
    "op11_conversation_repair": oracles.repaired(),
    "op12_resampling": oracles.resampled(),
    "op13_line_dedup": oracles.without_repeated_lines(),
    "op7_substring_dedup": r"""
        WITH texts AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), windows AS (
            SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS k
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM texts)
        ), hits AS (
            SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS least FROM windows) WHERE least < doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, p + o AS i FROM hits, range(0, 13) AS offsets(o)
        ), each_word AS (
            SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM texts
        ), kept AS (
            SELECT doc_id, count(*) AS n_words, count_if(out)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT out) AS left_words
            FROM (SELECT e.doc_id, e.i, e.word, g.i IS NOT NULL AS out FROM each_word e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i) GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_words, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (doc_id)
    """,
    "op8_exact_dedup": r"""
        WITH facts AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), named AS (
            SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n_chars, doc_id)) AS keep_id FROM facts GROUP BY norm
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM facts JOIN named USING (norm)
    """,
}
