"""Spark-native analytics for AI-agent and cloud audit telemetry.

Every operator takes and returns DataFrames.  Sub-packages:

* ``functions``  column expressions and the few Arrow UDFs
* ``sources``    readers and normalisers (JSONL, cloud audit logs, OTLP, MCP, A2A)
* ``operators``  detectors, joins, windows, statistics, graphs, gates, verification
* ``streaming``  Structured Streaming jobs
* ``sinks``      exports
* ``plans``      registered queries with their SQL counterparts
"""
