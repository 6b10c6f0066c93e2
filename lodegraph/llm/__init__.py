"""Operators for building language-model training corpora.

Nothing outside this folder imports it; its queries are listed in
``lodegraph.llm.registry``.
"""
