"""Registered queries of this package: name -> (Spark builder, DuckDB SQL or None)."""

from __future__ import annotations

import corpus_pipeline
from toposim.llm import bpe, chat, crosspoly, hosts, html_text, jaccard, merkle, packing, quality, repair, secrets, spelling, toxicity

REGISTRY = {
    "op1_chat_prefix_targets": (chat.query, chat.ORACLE_SQL),
    "op2_recurrent_blocks": (html_text.query, None),
    "op3_adaptive_quality": (quality.query, quality.ORACLE_SQL),
    "op4_byte_bpe": (bpe.query, None),
    "op5_merkle_fingerprints": (merkle.query, None),
    "op6_toxic_segments": (toxicity.query, None),
    "op7_ngram_jaccard": (jaccard.query, None),
    "op8_host_propagation": (hosts.query, hosts.ORACLE_SQL),
    "op9_certified_packing": (packing.query, None),
    "op10_secret_battery": (secrets.query, None),
    "op11_lattice_repair": (repair.query, repair.ORACLE_SQL),
    "op12_cross_polytope": (crosspoly.query, crosspoly.ORACLE_SQL),
    "op13_letter_count_trees": (spelling.query, spelling.ORACLE_SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
