"""Registered queries of the subpackage: name -> (function of (spark, sf_dir), DuckDB statement or None)."""
from __future__ import annotations

import public_tokenizers

from . import op1_toxicity, op2_fingerprint, op3_substring_dedup, op4_packing, op5_warc, op6_chat, op7_quality_votes, op8_odd_sketch, op9_bpe_automaton, op10_token_store
from . import op11_line_runs, op12_spelling_grams, op13_conversation_repair
from .text import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_toxicity_query(spark, sf_dir):
    return op1_toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprint_query(spark, sf_dir):
    return op2_fingerprint.digests(table(spark, sf_dir, "documents"))


def op3_substring_query(spark, sf_dir):
    return op3_substring_dedup.digests(table(spark, sf_dir, "documents"))


def op4_packing_query(spark, sf_dir):
    return op4_packing.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op5_warc_query(spark, sf_dir):
    return op5_warc.digests(table(spark, sf_dir, "pages"))


def op6_chat_query(spark, sf_dir):
    return op6_chat.digests(table(spark, sf_dir, "conversations"))


def op7_quality_query(spark, sf_dir):
    return op7_quality_votes.verdicts(table(spark, sf_dir, "documents"))


def op8_odd_sketch_query(spark, sf_dir):
    return op8_odd_sketch.components_of(table(spark, sf_dir, "documents"))


def op9_bpe_query(spark, sf_dir):
    return op9_bpe_automaton.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_token_store_query(spark, sf_dir):
    return op10_token_store.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op11_line_runs_query(spark, sf_dir):
    return op11_line_runs.digests(table(spark, sf_dir, "documents"))


def op12_spelling_query(spark, sf_dir):
    return op12_spelling_grams.groups(table(spark, sf_dir, "documents"))


def op13_repair_query(spark, sf_dir):
    return op13_conversation_repair.digests(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_toxicity": (op1_toxicity_query, None),
    "op2_fingerprint": (op2_fingerprint_query, None),
    "op3_substring_dedup": (op3_substring_query, op3_substring_dedup.ORACLE),
    "op4_packing": (op4_packing_query, None),
    "op5_warc": (op5_warc_query, op5_warc.ORACLE),
    "op6_chat": (op6_chat_query, op6_chat.ORACLE),
    "op7_quality_votes": (op7_quality_query, None),
    "op8_odd_sketch": (op8_odd_sketch_query, op8_odd_sketch.ORACLE),
    "op9_bpe_automaton": (op9_bpe_query, None),
    "op10_token_store": (op10_token_store_query, None),
    "op11_line_runs": (op11_line_runs_query, op11_line_runs.ORACLE),
    "op12_spelling_grams": (op12_spelling_query, None),
    "op13_conversation_repair": (op13_repair_query, None),
}
