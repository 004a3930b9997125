"""Queries over the test tables, each with the SQL that must give the same rows."""

from . import checks, files, inputs, joins, records, reports, standards

MODULES = (records, standards, reports, joins, checks, files, inputs)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
