"""caudal: receivables, payables and cash analytics as Spark DataFrame jobs.

Layers, in the order data flows:

* ``caudal.sources``   readers, decoders, the derived test ledger, the report sink
* ``caudal.operators`` staging, KPIs, reports, projections, alerts
* ``caudal.plans``     the registered queries, their DuckDB oracle, the publish job
* ``caudal.streaming`` the refresh stream
* ``caudal.functions`` shared column expressions
"""

__version__ = "0.1.0"
