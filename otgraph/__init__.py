"""otgraph — telemetry, triples and OT-event analytics as plain Spark DataFrame functions.

Every public function takes DataFrames (and plain parameters) and returns a DataFrame; nothing
is collected to the driver. Sub-packages:

* ``sources``   — readers and writers with fixed schemas (telemetry, tag payloads, OT events,
                  tag trees, Turtle models, template catalogues, N-Triples, snapshots)
* ``functions`` — column-level helpers (IRIs, event typing, KPI formulas)
* ``operators`` — row→triple mapping, latest / point-in-time, graph and pattern queries,
                  selection and change filters, silver/gold rollups, KPIs, model registry
* ``streaming`` — Structured Streaming twins of the batch operators
* ``plans``     — how the benchmark tables stand in for plant data, and the registered queries
"""

__version__ = "0.1.0"
