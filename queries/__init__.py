"""The operators of rowferry run on the test tables, each beside the SQL it must agree with."""

from queries import casts, checks, files, joins, loads, runs, shapes

_MODULES = (shapes, joins, casts, loads, checks, files, runs)
QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
