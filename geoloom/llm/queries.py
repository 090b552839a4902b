"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from geoloom.llm.conversation_repair import OP12_SQL, op12_conversation_repair
from geoloom.llm.decontaminate import OP7_SQL, op7_decontaminate
from geoloom.llm.fingerprints import OP13_SQL, op13_fingerprints
from geoloom.llm.lexical_search import OP11_SQL, op11_lexical_search
from geoloom.llm.lm_score import op4_lm_score
from geoloom.llm.mixing import op9_mix_sources
from geoloom.llm.near_dedup import OP3_SQL, op3_near_dedup
from geoloom.llm.quality import OP1_SQL, op1_quality_rules
from geoloom.llm.secret_scan import OP8_SQL, op8_secret_scan
from geoloom.llm.substring_dedup import op6_substring_dedup
from geoloom.llm.token_files import op10_token_files
from geoloom.llm.toxicity import op5_toxicity
from geoloom.llm.warc import OP2_SQL, op2_warc_transactions

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc_transactions": op2_warc_transactions,
    "op3_near_dedup": op3_near_dedup,
    "op4_lm_score": op4_lm_score,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_secret_scan": op8_secret_scan,
    "op9_mix_sources": op9_mix_sources,
    "op10_token_files": op10_token_files,
    "op11_lexical_search": op11_lexical_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_fingerprints": op13_fingerprints,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_quality_rules": OP1_SQL,
    "op2_warc_transactions": OP2_SQL,
    "op3_near_dedup": OP3_SQL,
    "op7_decontaminate": OP7_SQL,
    "op8_secret_scan": OP8_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_fingerprints": OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
