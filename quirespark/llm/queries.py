"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirespark.llm import exact_dedup, filter_audit, fingerprints, licenses, line_dedup, mixing, near_dedup, packing, phrases, quality_rules, suffix_dedup, toxicity, warc
from quirespark.llm.common import documents


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark, sf_dir):
    out = line_dedup.drop_common_blocks(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_warc(spark, sf_dir):
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op5_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("digest")


def op7_license_scan(spark, sf_dir):
    found = licenses.scan(documents(spark, sf_dir))
    return found.select("doc_id", "sentence_ids", F.array_join("licenses", ",").alias("licenses"), "n_matches")


def op8_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(documents(spark, sf_dir))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op10_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


def op11_quality_rules(spark, sf_dir):
    book = quality_rules.verdicts(quality_rules.ledger(documents(spark, sf_dir)))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits")


def op12_phrase_mining(spark, sf_dir):
    return phrases.collocations(documents(spark, sf_dir))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(filter_audit.flagged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op")}
