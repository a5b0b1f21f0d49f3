"""All registered queries over the test tables, and their SQL counterparts."""

from __future__ import annotations

from quillgrid.plans import kinds, ranges, relational, scalars, searches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (ranges, relational, scalars, kinds, searches):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
# Names that these had while they read whole tables and others beside them did not.
for _name in ("scalar_round", "cf_flags", "lint_cache_mismatch", "product_by_flag"):
    QUERIES[f"{_name}_all"], ORACLES[f"{_name}_all"] = QUERIES[_name], ORACLES[_name]
