"""Every query of this subpackage with its SQL."""

from __future__ import annotations

from lodestone.llm import itq_dedup, katz, mixing, nn_descent, packing, quality, simhash, substring_dedup, suffix_dedup, toxicity

_MODULES = [simhash, itq_dedup, nn_descent, quality, toxicity, katz, mixing, nn_descent, packing, substring_dedup, suffix_dedup]
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
