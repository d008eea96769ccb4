"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import embedding_dedup, html_text, license_scan, line_dedup, mixing, ngram_join, packing, periodic_runs, quality_rules, sharding, token_files, treap_search, warc

_MODULES = (mixing, line_dedup, packing, sharding, embedding_dedup, html_text, ngram_join, quality_rules, warc, license_scan, periodic_runs, treap_search, token_files)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
