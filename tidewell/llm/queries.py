"""The registered queries of the thirteen operators and the SQL that agrees with those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import align_documents
from .common import table
from .decontaminate import find_items
from .html_extract import extract_pages
from .jaccard_join import join_report
from .licenses import scan_licenses
from .lm_score import score_documents
from .packing import pack_documents
from .quality import quality_report
from .sharding import shard_documents
from .suffix_dedup import repeat_report
from .token_files import read_token_files, write_token_files
from .warc import read_archives, write_archives
from .whitening import whiten


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"), length=400, passage_words=51)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write_token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, folder, manifest)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_report(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = write_archives(table(spark, sf_dir, "pages"), min_revisit=0)
    return read_archives(spark, folder, index)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), n_shards=8)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=16)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_files": op5_token_files,
    "op6_quality_rules": op6_quality_rules,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_warc": op8_warc,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_license_scans": op11_license_scans,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
    "pipeline": pipeline,
}

_OP6 = r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
 c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
 l AS (SELECT doc_id, host, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
 m AS (SELECT doc_id, host, n_words, word_chars, n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM l LEFT JOIN c USING (doc_id)),
 f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols > 0.3 * n_words OR n_dup_lines > 0.3 * n_lines OR NOT word_chars BETWEEN 2.0 * n_words AND 12.0 * n_words AS soft_failed FROM m),
 h AS (SELECT host, count(*) AS n, sum(CASE WHEN base_failed OR soft_failed THEN 1.0 ELSE 0 END) AS k FROM f GROUP BY host),
 p AS (SELECT count(*) AS h, sum(n) AS n, sum(k) AS k, sum(k * k / n) AS s FROM h), q AS (SELECT k / n AS mean, (s - k * k / n) / n - k / n * (1 - k / n) * h / n AS between_hosts FROM p),
 z AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(between_hosts, 1e-9) - 1, 1.0), 1e6) AS ab FROM q),
 v AS (SELECT host, (k + mean * ab) / (n + ab) > least(0.5, mean + 2 * sqrt(mean * (1 - mean) / (ab + 1))) AS bad FROM h, z)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (soft_failed AND bad) AS kept FROM f JOIN v USING (host)"""

#: The others are suffix arrays, codes, archives, models and searches that SQL doesn't express; tests hold them
#: against brute force, exact round trips or held-out texts.
ORACLES: dict[str, str] = {"op6_quality_rules": _OP6}
