"""Every registered query of the reference's own operators, with its DuckDB SQL."""

from __future__ import annotations

from plumbline.plans import adjustment, evaluation, geometry, mapping, measurement, reports

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (measurement, adjustment, mapping, evaluation, geometry, reports):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
