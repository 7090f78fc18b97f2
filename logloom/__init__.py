"""Log and trace analytics on Spark DataFrames.

Packages: ``functions`` (column expressions), ``sources`` (envelopes, event table, config tables),
``operators`` (DataFrame to DataFrame), ``plans`` (ingest, table maintenance, user SQL),
``streaming`` (Structured Streaming jobs) and ``suite`` (the registered queries with their SQL oracles).
"""
