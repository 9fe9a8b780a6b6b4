"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from turnstone.llm import op1_quality, op2_language, op3_mixing, op4_packing, op5_warc, op6_anomalies, op7_exact, op8_sharding, op9_minhash, op10_licenses

_MODULES = (op1_quality, op2_language, op3_mixing, op4_packing, op5_warc, op6_anomalies, op7_exact, op8_sharding, op9_minhash, op10_licenses)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
