"""All queries of the library: name -> (query, SQL or None)."""

from __future__ import annotations

from . import claims, comments, curate, decide, evaluate, vectors

QUERIES = {**comments.QUERIES, **evaluate.QUERIES, **claims.QUERIES, **decide.QUERIES, **curate.QUERIES, **vectors.QUERIES}
