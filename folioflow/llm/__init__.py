"""Operators for training data; nothing else in the library imports this subpackage."""

#: The modules of this subpackage that hold queries.
QUERY_MODULES = ("queries_defects", "queries_matching", "queries_spellings", "queries_history", "queries_chunks", "queries_neighbours", "queries_tokens", "queries_mixing", "queries_personal")
