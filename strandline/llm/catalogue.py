"""The registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline

from . import language, lm_score, neighbours, packing, secrets, sharding, simhash, token_output, url_filter, winnowing

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_packing": packing.op2_packing,
    "op3_language_id": language.op3_language_id,
    "op4_nearest": neighbours.op4_nearest,
    "op5_secrets": secrets.op5_secrets,
    "op6_decontamination": winnowing.op6_decontamination,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_token_output": token_output.op9_token_output,
    "op10_simhash": simhash.op10_simhash,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op5_secrets": secrets.ORACLE_SQL,
    "op6_decontamination": winnowing.ORACLE_SQL,
    "op7_url_filter": url_filter.ORACLE_SQL,
    "op8_lm_score": lm_score.ORACLE_SQL,
}
