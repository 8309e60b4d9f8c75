"""The registered queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from .archives import OP4_SQL, op4_archives
from .fingerprints import op3_fingerprints
from .jaccard_join import OP8_SQL, op8_jaccard_join
from .mixing import OP7_SQL, op7_mixing
from .packing import op5_packing
from .pii import op1_pii
from .quality_classifier import op9_quality_classifier
from .quality_rules import op6_quality_rules
from .toxicity import op10_toxicity
from .url_filter import op2_url_filter

QUERIES = {
    "op1_pii": op1_pii,
    "op2_url_filter": op2_url_filter,
    "op3_fingerprints": op3_fingerprints,
    "op4_archives": op4_archives,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op4_archives": OP4_SQL,
    "op7_mixing": OP7_SQL,
    "op8_jaccard_join": OP8_SQL,
}
