"""neo: near-Earth-object analytics on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, Spark ML and Structured Streaming, so the same code runs in batch
and inside micro-batches.  Sub-packages:

* ``neo.functions``  - column-expression builders (vectors, risk ladders, time)
* ``neo.operators``  - table operators (features, physics, joins, aggregates, ML)
* ``neo.sources``    - table / message sources and sinks, domain views
* ``neo.streaming``  - Structured Streaming jobs
* ``neo.plans``      - composite pipelines and the query catalog
"""

__version__ = "0.1.0"
