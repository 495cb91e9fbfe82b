"""chatlake: analytics over AI-assistant conversation transcripts on Spark.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from
DataFrame / Spark SQL primitives, so Catalyst plans the whole query and
nothing is pulled through the driver.  Sub-packages:

* ``sources``   - transcript line scans, relational store, derived views
* ``operators`` - filters, search, listing, reading, usage, tree/lineage
* ``functions`` - column expressions (text, time, JSON)
* ``store``     - versioned Parquet table set and incremental maintenance
* ``streaming`` - Structured Streaming twins of ingest and roll-ups
* ``plans``     - the registered queries and their SQL oracles
"""

__version__ = "0.1.0"
