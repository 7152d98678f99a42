"""Queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tracelake.llm import collocations, decontaminate, extract, licenses, neardup, packing, pseudonyms, quality, resampling, secrets, substrings, tokens, warc

QUERIES = {}
ORACLES = {}
for module in (warc, extract, pseudonyms, decontaminate, tokens, substrings, licenses, neardup, packing, quality, resampling, collocations, secrets):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
