"""marginalia: retrieval, evidence analytics and corpus processing as Spark plans.

Subpackages: ``sources`` (files, store, manifests), ``functions`` (column
expressions), ``operators`` (DataFrame in, DataFrame out), ``plans`` (registered
queries and their SQL), ``streaming`` (file-stream synchronisation) and, where
installed, ``llm`` (training-data operators, imported by nothing else here).
"""

__version__ = "0.1.0"
