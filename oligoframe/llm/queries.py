"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .decontaminate import op7_benchmark_decontamination
from .fingerprint import op5_document_fingerprints
from .html import op1_html_extraction
from .jaccard import op3_jaccard_join
from .licenses import op10_license_scan
from .lines import op4_line_dedup
from .mixing import OP6_SQL, op6_mixing
from .pii import op8_pii
from .substrings import op9_suffix_dedup
from .toxicity import op2_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_toxicity,
        op3_jaccard_join,
        op4_line_dedup,
        op5_document_fingerprints,
        op6_mixing,
        op7_benchmark_decontamination,
        op8_pii,
        op9_suffix_dedup,
        op10_license_scan,
    )
}
#: The other operators are trained or iterative, or too slow in SQL on whole tables; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op6_mixing": OP6_SQL}
