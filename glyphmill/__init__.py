"""glyphmill: a Spark-first engine for document collections.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (files, tables), ``plans`` (whole queries),
``streaming`` and ``llm`` (operators for training data, optional).
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
