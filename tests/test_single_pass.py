"""Operators that read their input once."""

from caseweave import runtime
from caseweave.operators import detectors as D
from caseweave.operators import graph as G
from caseweave.plans import load_all
from caseweave.plans.registry import QUERIES
from caseweave.sources import traces as TR

load_all()


def test_network_rules_and_labels_share_one_pass(spark):
    rows = [("a", "x" * 30 + ".Tunnel.example.", "dns", True), ("b", "example", "dns", True), ("c", "ok.corp.example", "http", False)]
    events = spark.createDataFrame(rows, "event_id string, hostname string, channel string, contains_sensitive_source_hash boolean")
    found = D.network_exfil(events)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert sorted((r["event_id"], r["type"]) for r in found.collect()) == [
        ("a", "dns_data_like_subdomain_label"), ("a", "dns_query_correlated_with_sensitive_source"),
        ("b", "dns_query_correlated_with_sensitive_source")]


def test_trace_edges_parse_spans_once(spark, sf):
    edges = QUERIES["r8_trace_edges"](spark, sf)
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Relation [event_id") == 0
    assert edges.count() == 1262


def test_attribute_lists_and_objects(spark):
    attrs = ['[{"key":"a","value":{"stringValue":"x"}},{"key":"n","value":{"intValue":"5"}}]', '{"a":"x","n":5}', "[]", "null", "{}",
             '[{"key":"a","value":{"stringValue":"x"}},{"key":"a","value":{"stringValue":"y"}}]', '[{"value":{"stringValue":"x"}}]']
    raw = ['{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"","trace_id":"%s","attributes":%s}]}]}]}' % ("A" * 32, a) for a in attrs]
    spans = TR.trace_envelopes(spark.createDataFrame(list(enumerate(raw)), "source_id int, raw string"))
    got = {r["source_id"]: (r["attrs"], r["reject"]) for r in spans.collect()}
    both, twice = ({"a": "x", "n": "5"}, None), ({}, "duplicate_attribute_key")
    assert got == {0: both, 1: both, 2: ({}, None), 3: ({}, None), 4: ({}, None), 5: twice, 6: twice}
    assert {r["trace_id"] for r in spans.collect()} == {"A" * 32}


def test_cycles_stop_once_no_chain_ends(spark):
    rows = [(1, f"{i}", f"{i ^ 1}") for i in range(200)] + [(2, "x", "y"), (2, "y", None), (2, "z", "x")]
    written = len(runtime._WRITTEN)
    found = G.parent_cycles(spark.createDataFrame(rows, "trace int, node string, parent string"))
    assert len(runtime._WRITTEN) - written <= 4
    assert {(r["trace"], r["node"]) for r in found.collect()} == {(1, f"{i}") for i in range(200)}
