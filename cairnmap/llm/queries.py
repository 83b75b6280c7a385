"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from . import audio, decontaminate, licenses, line_dedup, lm, mixing, name_join, near_dup, periodic, quality, simhash, toxicity, warc

MODULES = (toxicity, decontaminate, licenses, lm, audio, near_dup, mixing, quality, warc, line_dedup, simhash, name_join, periodic)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
