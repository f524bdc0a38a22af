"""Registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from repoaudit.llm.decontaminate import op7_decontamination
from repoaudit.llm.embedding_near import op11_embedding_near
from repoaudit.llm.filter_audit import op13_filter_audit
from repoaudit.llm.line_dedup import op2_line_dedup
from repoaudit.llm.mixing import op6_mixing
from repoaudit.llm.ngram_join import op4_ngram_join
from repoaudit.llm.oracles import ORACLES  # noqa: F401
from repoaudit.llm.pii import op1_pii
from repoaudit.llm.quality import op5_quality
from repoaudit.llm.resample import op12_resample
from repoaudit.llm.substrings import op9_substring_dedup
from repoaudit.llm.token_counts import op3_token_counts
from repoaudit.llm.token_output import op8_token_output
from repoaudit.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_pii": op1_pii,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_ngram_join": op4_ngram_join,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_token_output": op8_token_output,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_embedding_near": op11_embedding_near,
    "op12_resample": op12_resample,
    "op13_filter_audit": op13_filter_audit,
}

