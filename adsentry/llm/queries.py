"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from . import byte_pairs, decontaminate, exact_digest, html_text, language, merkle, pieces, quality, secret_scan, simhash_dedup, spelling, substring_dedup, window_index

_MODULES = (secret_scan, substring_dedup, language, html_text, pieces, simhash_dedup, decontaminate, window_index, quality, exact_digest, byte_pairs, spelling, merkle)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
