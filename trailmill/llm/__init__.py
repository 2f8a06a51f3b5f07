"""Operators for preparing training text, each in a module of its own.

``queries()`` and ``oracle_sql()`` gather what the modules register; nothing
outside this package imports it except the entry point, which does so behind a
guard. The modules are imported here, so that a package that is missing shows
at import, where that guard is.
"""

from __future__ import annotations

from . import compaction, filteraudit, flac, hmm, jaccard, mixing, pieces, pii, quality, simhash, tokenfile, topk, toxicity

MODULES = (topk, jaccard, flac, mixing, hmm, toxicity, pieces, quality, tokenfile, pii, compaction, simhash, filteraudit)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
