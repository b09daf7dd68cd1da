"""The package's registered queries."""

from corpusloom.llm import cross, dress, equal_forms, groups, leaks, mixing, near, sqltext, subjects

MODULES = (equal_forms, cross, near, groups, dress, leaks, mixing, subjects)
QUERIES: dict = {}
SQL: dict = dict(sqltext.SQL)
for _m in MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
