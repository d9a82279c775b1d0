"""Training-data operators: one module for each, queries and SQL in :mod:`lumisieve.llm.queries`.

Nothing outside this subpackage imports it.
"""
