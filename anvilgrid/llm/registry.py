"""Queries of the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from anvilgrid.llm import bpe, chunks, decontaminate, flac, jaccard, pii, quality, secret_scan, substrings, toxicity

QUERIES = {
    "op1_flac": flac.op1_flac,
    "op2_quality": quality.op2_quality,
    "op3_pii": pii.op3_pii,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_chunks": chunks.op6_chunks,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_substrings": substrings.op8_substrings,
    "op9_bpe": bpe.op9_bpe,
    "op10_secrets": secret_scan.op10_secrets,
}
ORACLES = {"op4_jaccard": jaccard.ORACLE_SQL, "op5_decontaminate": decontaminate.ORACLE_SQL}
