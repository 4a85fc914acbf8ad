"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it; its queries are registered by
``__spark_entry__`` only when the subpackage can be imported.
"""
