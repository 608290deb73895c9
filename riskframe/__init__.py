"""riskframe — loan-default feature, audit and blending operators on Spark.

Subpackages
- ``sources``   driver-table readers, the ``loans`` view, feature-table I/O
- ``functions`` column expressions (parsers, ratios, row statistics)
- ``operators`` fit-then-apply encoders, folds, metrics, audits, blending, training
- ``plans``     feature pipelines v1/v2/v3/notebook and the named query catalog
- ``streaming`` incremental scoring of new loans against fitted encoder tables
"""

__version__ = "0.1.0"
