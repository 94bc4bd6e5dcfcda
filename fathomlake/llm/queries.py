"""Queries and SQL of this subpackage."""

from __future__ import annotations

from .exact_dedup import OP7_SQL, op7_exact_dedup
from .html_text import op2_html_text
from .line_dedup import OP9_SQL, op9_line_dedup
from .mixing import OP5_SQL, op5_mix_sources
from .ngram_join import op4_ngram_join
from .packing import op10_packing
from .quality import OP6_SQL, op6_quality_rules
from .rans import op8_token_files
from .secrets import op1_secret_scan
from .suffix_dedup import op3_suffix_dedup

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_html_text": op2_html_text,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_mix_sources": op5_mix_sources,
    "op6_quality_rules": op6_quality_rules,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_files": op8_token_files,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
}

ORACLE_SQL = {
    "op5_mix_sources": OP5_SQL,
    "op6_quality_rules": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op9_line_dedup": OP9_SQL,
}
