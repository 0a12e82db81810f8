"""The registered queries of this package and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import crosstok, decontam, embdedup, fim, lines, neardup, packing, quality, rlz, suffixes, tokenfile, toxicity, urls
from .common import Work, fold, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression quality of all documents; fitted on labels of the folds other than 0 of 5."""
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less the later copies of repeated line runs."""
    done = lines.dedup(Work(spark, "op9"), table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", "n_lines", "n_removed", "n_runs")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; fitted on labels of the folds other than 1 of 3."""
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings by cosine."""
    return embdedup.near_duplicates(Work(spark, "op2"), table(spark, sf_dir, "embeddings"))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the corpus as a token-id file and reads per-document offsets and checksums back from it."""
    path = f"{Work(spark, 'op3').path}/file"
    tokenfile.write(table(spark, sf_dir, "documents"), path)
    return tokenfile.read(spark, path, with_ids=False)


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less every byte of a 100-byte string that also starts earlier."""
    return suffixes.dedup(Work(spark, "op4"), table(spark, sf_dir, "documents"), with_text=False)


#: The rules of the registered query.
RULES = [urls.Rule("block", "com", "/en/"), urls.Rule("allow", "example.com", "/en/7"), urls.Rule("allow", "net", "/de/"), urls.Rule("block", "example.net", "/de/8"), urls.Rule("block", "org", "/es/")]


def op5_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict of all pages."""
    return urls.judge(Work(spark, "op5"), table(spark, sf_dir, "pages"), RULES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which items of the benchmark leak."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return neardup.near_duplicates(Work(spark, "op10"), table(spark, sf_dir, "documents"))


def op11_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less every word of a 35-word window that also starts anywhere else."""
    parsed = rlz.parse(Work(spark, "op11"), table(spark, sf_dir, "documents"))
    return parsed.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over all documents, with corpus-wide counts of linked ids."""
    return crosstok.alignment(Work(spark, "op12"), table(spark, sf_dir, "documents"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arranged for filling in the middle, with checksums of the outputs and of the texts rebuilt from them."""
    done = fim.transform(table(spark, sf_dir, "documents"), with_output=False)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_binary_codes": op2_binary_codes,
    "op3_token_file": op3_token_file,
    "op4_suffixes": op4_suffixes,
    "op5_redirects": op5_redirects,
    "op6_packing": op6_packing,
    "op7_bm25_leaks": op7_bm25_leaks,
    "op8_toxicity": op8_toxicity,
    "op9_line_runs": op9_line_runs,
    "op10_probminhash": op10_probminhash,
    "op11_rlz": op11_rlz,
    "op12_alignment": op12_alignment,
    "op13_fim": op13_fim,
}

ORACLE_SQL: dict[str, str] = {
    "op2_binary_codes": embdedup.ORACLE_SQL,
    "op5_redirects": urls.ORACLE_SQL,
    "op9_line_runs": lines.ORACLE_SQL,
    "op11_rlz": rlz.ORACLE_SQL,
    "op13_fim": fim.ORACLE_SQL,
}
