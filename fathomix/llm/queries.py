"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomix.llm import (
    alignment, collocations, decontaminate, edit_counts, kneser_ney, packing, paragraphs, pieces, quality, shards,
    simhash, surrogates, tokens, vamana,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=3, shingle=3)


def op2_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality.fold(folds=5) == 1
    scored = kneser_ney.scores(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(_table(spark, sf_dir, "documents"), "op5").select("doc_id", "text", "replaced")


def op6_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokens.DEFAULT, length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def house_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits as a cleaning step makes them: repeated long lines go, long numbers are masked."""
    edits, seen, at = [], set(), 0
    for line in text.split("\n"):
        end = at + len(line)
        if len(line) >= 20 and line in seen:
            edits.append((at, min(end + 1, len(text)), ""))
        else:
            seen.add(line)
            edits += [(at + m.start(), at + m.end(), "<number>") for m in re.finditer(r"[0-9][0-9 ().-]{4,}[0-9]", line)]
        at = end + 1
    return edits


def op8_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = edit_counts.with_trees(_table(spark, sf_dir, "documents"), tokens.DEFAULT)
    return edit_counts.apply_edits(counted, tokens.DEFAULT, house_edits)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_spans(_table(spark, sf_dir, "documents"))


def op10_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = shards.even_tree(8)
    placed = shards.shard_rows(_table(spark, sf_dir, "documents"), tree, shards.grown(tree, 8))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encoded(_table(spark, sf_dir, "documents"), pieces.DEFAULT)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(_table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.aligned(_table(spark, sf_dir, "documents"), spelt=True)
    digest = F.when(F.col("n_groups") == 0, F.lit("")).otherwise(F.sha2("groups", 256))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_kneser_ney_scores, op3_benchmark_decontamination, op4_quality_classifier,
    op5_pii_surrogates, op6_graph_neighbours, op7_mixture_packing, op8_edit_aware_counts, op9_repeated_passages,
    op10_hash_tree_sharding, op11_piece_ids, op12_phrase_collocations, op13_tokenizer_alignment,
)}
