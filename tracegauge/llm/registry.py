"""Queries over the training-data operators: each with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers

from . import bpe, conversations, exact_dedup, near_dedup, packing, quality_classifier, quality_rules, recompression, sharding, token_counts, toxicity, warc
from .common import table


def op1_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op4_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op6_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_token_counts(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_quality_classifier(spark, sf_dir):
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    return conversations.conversation_repair(table(spark, sf_dir, "conversations"))


def op12_substring_dedup(spark, sf_dir):
    return recompression.substring_dedup(table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_toxicity": op2_toxicity,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_packing": op4_packing,
        "op5_near_dedup": op5_near_dedup,
        "op6_sharding": op6_sharding,
        "op7_warc": op7_warc,
        "op8_token_counts": op8_token_counts,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_substring_dedup": op12_substring_dedup,
    }


def oracle_sql():
    return {"op7_warc": warc.SQL, "op10_exact_dedup": exact_dedup.SQL, "op11_conversation_repair": conversations.SQL, "op12_substring_dedup": recompression.SQL}
