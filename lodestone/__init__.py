"""Lodestone: analytics and hybrid search over large tables, written for Spark.

``sources``    tables, run history, result files, the embedding store
``functions``  column expressions: analyzers, perturbations, vector helpers
``operators``  joins, sampling, search, embedding, evaluation, SQL access
``plans``      the registered queries, each beside its SQL check
"""

__version__ = "0.1.0"
