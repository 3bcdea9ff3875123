"""The queries of this subpackage, by name, and SQL for those that it can express."""

from __future__ import annotations

from .byte_cnn import op11_quality_classifier
from .decontamination import op3_decontamination
from .line_dedup import op5_line_dedup
from .lm_scoring import op2_lm_scoring
from .merkle import SQL as MERKLE_SQL
from .merkle import op12_merkle_manifest
from .periodic_runs import op13_periodic_runs
from .quality_rules import op9_quality_rules
from .quotations import op4_quotations
from .secret_scan import op6_secret_scan
from .sentencepieces import op1_sentencepiece
from .sharding import op8_sharding
from .simhash import op7_simhash
from .token_counts import op10_token_counts

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_quotations": op4_quotations,
    "op5_line_dedup": op5_line_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_simhash": op7_simhash,
    "op8_sharding": op8_sharding,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {"op12_merkle_manifest": MERKLE_SQL}
