"""Operators for preparing language-model training text, each a Spark job over whole tables.

Nothing outside this subpackage imports it; :mod:`serieslab.llm.queries` holds the registered
queries and :mod:`serieslab.llm.oracles` the SQL they are compared with.
"""
