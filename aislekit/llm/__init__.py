"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage; its queries are collected in
``aislekit.llm.queries``.
"""
