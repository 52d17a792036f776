"""The queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

import corpus_pipeline
from edgeloom.llm import decontaminate, html_text, language, merkle, packing, sharding, simhash, suffix_dedup, token_files, toxicity

QUERIES = {
    "op1_language": language.query,
    "op2_packing": packing.query,
    "op3_simhash": simhash.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_merkle": merkle.query,
    "op6_token_files": token_files.query,
    "op7_decontaminate": decontaminate.query,
    "op8_toxicity": toxicity.query,
    "op9_sharding": sharding.query,
    "op10_html_text": html_text.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op5_merkle": merkle.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
