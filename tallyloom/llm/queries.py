"""The queries of the ten corpus operators, with production parameters over whole tables, and their SQL twins."""

from __future__ import annotations

from . import decontam, langid, mixing, ngram_lm, quality, secret_scan, simhash, token_ids, toxicity, url_filter

QUERIES = {f.__name__: f for f in (
    token_ids.op1_token_ids,
    simhash.op2_simhash,
    toxicity.op3_toxicity,
    langid.op4_language_id,
    ngram_lm.op5_lm_score,
    url_filter.op6_url_filter,
    decontam.op7_decontaminate,
    mixing.op8_mix_sources,
    quality.op9_quality_rules,
    secret_scan.op10_secret_scan,
)}

#: Only what SQL can express; the others are tested against brute force or round trips in tests/llm.
ORACLES = {"op6_url_filter": url_filter.ORACLE, "op7_decontaminate": decontam.ORACLE, "op8_mix_sources": mixing.ORACLE}
