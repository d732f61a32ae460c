"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; its queries are in
``millrace.llm.queries`` and its tests in ``tests/llm``.
"""
