"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from foliospark.llm import decontamination, jaccard_join, line_dedup, license_scan, mixing, quality_classifier, quality_rules, sharding, token_counts, toxicity

_MODULES = (quality_classifier, decontamination, sharding, mixing, toxicity, license_scan, token_counts, quality_rules, jaccard_join, line_dedup)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
