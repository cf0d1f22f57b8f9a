"""Operators on small hand-made rows, with the finding types they must raise."""

import datetime as dt

from pyspark.sql import functions as F

from caseweave.operators import authority as A
from caseweave.operators import detectors as D
from caseweave.operators import graph as G
from caseweave.operators import joins as J
from caseweave.operators import windows as W
from caseweave.operators.ordered import prior, time_chunk

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def types(df):
    return sorted(r["type"] for r in df.select("type").collect())


def test_unapproved_route(spark):
    e = spark.createDataFrame([("r1", "m1", "m9", "p", "eu", "strict", False, "h")],
                              "request_id string, requested_model string, resolved_model string, provider string, region string, "
                              "safety_profile string, fallback_approved boolean, router_policy_sha256 string")
    policy = {"allowed_models": ["m1"], "minimum_safety_profile": "unlisted", "safety_profile_order": ["lax", "strict"]}
    assert types(D.model_routing(e, policy)) == ["safety_policy_downgrade", "unapproved_model_failover", "unapproved_model_resolution"]


def test_empty_allow_list_disables_check(spark):
    e = spark.createDataFrame([("r1", None, "m9")], "request_id string, requested_model string, resolved_model string")
    assert types(D.model_routing(e, {})) == []


def test_dns_label(spark):
    e = spark.createDataFrame([("1", "dns", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa.x.example", True), ("2", "http", "www.ok.example", False)],
                              "event_id string, channel string, hostname string, contains_sensitive_source_hash boolean")
    assert types(D.network_exfil(e)) == ["dns_data_like_subdomain_label", "dns_query_correlated_with_sensitive_source"]


def test_websocket_origin(spark):
    e = spark.createDataFrame([("1", "s", "websocket_connect", "wss://evil.example/x")], "event_id string, session_id string, event_type string, url string")
    assert types(D.browser_activity(e, ws_origins=["wss://trusted.example"])) == ["browser_unapproved_websocket_origin"]


def test_workload_identity_at_event_time(spark):
    e = spark.createDataFrame([("1", at(5), "spiffe://a/w", at(0), at(3), None), ("2", at(1), "spiffe://a/w", at(0), at(3), None)],
                              "event_id string, ts timestamp, spiffe_id string, not_before timestamp, expires timestamp, revoked timestamp")
    got = D.workload_identity(e, ["a"], None).collect()
    assert [(r["type"], r["event_id"]) for r in got] == [("workload_identity_used_after_expiry", "1")]


def test_mcp_fixture(spark):
    e = spark.createDataFrame(
        [("1", {"Mcp-Method": "tools/list"}, "tools/call", "https://bad", "https://good", "plain", "ui://x", "open", ["https://evil.example/a"])],
        "event_id string, headers map<string,string>, body_method string, issuer string, expected_issuer string, pkce_method string, "
        "ui_uri string, app_host_rpc_method string, app_external_urls array<string>")
    got = set(types(D.mcp_events(e, ["https://ok.example"])))
    assert {"mcp_header_body_method_mismatch", "mcp_authorization_issuer_mismatch", "mcp_pkce_not_s256",
            "mcp_app_unapproved_external_origin", "mcp_app_unapproved_host_rpc"} <= got


def test_undeclared_skill(spark):
    e = spark.createDataFrame([("1", "t", "s2")], "event_id string, task_id string, skill_id string")
    card = {"policy_satisfied": True, "trusted": True, "card_identity": {"skills": ["s1"]}}
    assert types(D.a2a_binding(e, card)) == ["a2a_undeclared_skill_invoked"]


def test_terminal_and_unicode(spark):
    d = spark.createDataFrame([(1, "\x1b[2J hi \x1b]52;c;Zm9v\x07"), (2, "a\u202eb\U000e0041")], "doc_id int, text string")
    assert set(types(D.terminal_controls(d))) == {"terminal_cursor_or_display_control", "terminal_osc52_clipboard_control"}
    assert set(types(D.unicode_smuggling(d))) == {"unicode_bidi", "unicode_tag"}


def test_memory_cross_tenant_and_expiry(spark):
    cols = ("event_id string, event_type string, ts timestamp, ord bigint, tenant_id string, memory_id string, version int, content_sha256 string, "
            "expected_content_sha256 string, source_event_id string, expires timestamp, embedding_model string, actor_id string, has_cause boolean")
    row = lambda i, t, m, ten, exp=None, typ="memory_read", ver=None: (i, typ, at(t), t, ten, m, ver, "h", None, "src", exp, None, "w", False)
    e = spark.createDataFrame([row("w1", 0, "m", "T1", at(5), "memory_write", 1), row("r1", 1, "m", "T2"), row("r2", 9, "m", "T1"),
                               row("w2", 10, "m", "T1", None, "memory_write", 1), row("d", 11, "m", "T1", None, "memory_delete"), row("r3", 12, "m", "T1"),
                               row("r4", 13, "other", "T1")], cols)
    got = {(r["type"], r["event_id"]) for r in J.memory_integrity(e, time_chunk("ts", 120), ["w"]).collect()}
    assert got == {("memory_cross_tenant_read", "r1"), ("memory_read_after_expiry", "r2"), ("memory_version_regression_or_replay", "w2"),
                   ("memory_read_after_tombstone", "r3"), ("memory_read_without_version_evidence", "r4")}


def test_temporal_authority_deny_and_window(spark):
    a = spark.createDataFrame([("a1", "p", at(10), None, None, None, ["read", "write"]), ("a2", "p", at(90), None, None, None, ["read"])],
                              "action_id string, principal string, ts timestamp, tenant string, resource string, purpose string, required array<string>")
    rule = "principal string, scopes array<string>, tenant string, resource string, purposes array<string>, not_before timestamp, expires timestamp, revoked timestamp, disabled boolean"
    g = spark.createDataFrame([("p", ["read"], None, None, None, at(0), at(30), None, False), ("p", ["read", "write"], None, "*", [], at(20), at(60), None, False),
                               ("p", ["write"], None, None, None, None, None, None, False)], rule)
    d = spark.createDataFrame([("*", ["write"], None, None, None, at(0), None, None, False)], rule)
    got = {r["action_id"]: (r["scopes"], r["first_missing"]) for r in A.temporal_authority(a, g, d).collect()}
    assert got == {"a1": (1, "write"), "a2": (0, "read")}


def test_merged_validity_windows(spark):
    rule = "principal string, scopes array<string>, tenant string, resource string, purposes array<string>, not_before timestamp, expires timestamp, revoked timestamp, disabled boolean"
    rows = [("p", ["s"], None, None, None, at(a), at(b), None, False) for a, b in ((0, 10), (5, 20), (20, 30), (40, 50))]
    got = sorted((r["start"], r["end"]) for r in A.validity_windows(spark.createDataFrame(rows, rule)).collect())
    assert got == [(at(0), at(30)), (at(40), at(50))]


def test_claim_counts_states(spark):
    e = spark.createDataFrame([("S", "M"), ("M", "T"), ("S", "T"), ("T", "C"), ("C", "S")], "src string, dst string")
    c = spark.createDataFrame([("c1", "S", "C"), ("c2", "C", "X")], "claim_id string, source string, target string")
    got = {r["claim_id"]: (r["path_count"], r["supported"]) for r in G.claim_support(e, c).collect()}
    assert got == {"c1": (2, True), "c2": (0, False)}


def test_reach_on_cycle_and_shortest_tie(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c")], "src string, dst string")
    s = spark.createDataFrame([("a", "a")], "seed string, node string")
    assert {(r["node"], r["depth"]) for r in G.reach(e, s).collect()} == {("b", 1), ("d", 1), ("c", 2), ("a", 3)}
    order = spark.createDataFrame([(x, i) for i, x in enumerate("adbc")], "event_id string, ord int")
    t = spark.createDataFrame([("c",)], "node string")
    assert G.shortest_paths(e, order, s, t).collect()[0]["path"] == ["a", "d", "c"]


def test_cycle_detection(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "y")], "src string, dst string")
    assert {r["node"] for r in G.below_cycle(e).collect()} == {"b", "c", "d"}
    p = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "c", "a"), (2, "x", "y"), (2, "y", None)], "trace int, node string, parent string")
    assert {(r["trace"], r["node"]) for r in G.parent_cycles(p).collect()} == {(1, "a"), (1, "b"), (1, "c")}


def test_collector_missing_is_not_clean(spark):
    e = spark.createDataFrame([("s1", True, 10, None, None), ("s2", True, 10, None, None)],
                              "source_id string, mandatory boolean, expected_events int, min_event_ratio double, max_clock_uncertainty_ms double")
    o = spark.createDataFrame([("s1", True, 10, None, None, None, None, None)],
                              "source_id string, enabled boolean, collected_events int, last_error string, coverage_start timestamp, coverage_end timestamp, "
                              "retention_gap_seconds double, clock_uncertainty_ms double")
    h = J.collector_health(e, o)
    assert types(J.collector_findings(h)) == ["mandatory_evidence_source_unavailable"]
    assert J.complete_mandatory(h).collect()[0][0] is False


def test_task_after_cancel(spark):
    e = spark.createDataFrame([("1", "t", "tasks/cancel", "cancelled", at(0), 0), ("2", "t", "tools/call", "working", at(1), 1), ("3", "t", "tasks/get", "completed", at(2), 2)],
                              "event_id string, task_id string, mcp_method string, state string, ts timestamp, ord int")
    assert [r["event_id"] for r in W.task_activity_after_cancel(e, ["tasks/get", "tools/call"]).collect()] == ["2"]


def test_prior_is_permutation_invariant_and_chunk_invariant(spark):
    rows = [("k" if i % 3 else None, at(i * 17 % 400), i, i * 7 % 11) for i in range(200)]
    specs = {"last": ("last", F.when(F.col("v") % 2 == 0, F.col("v"))), "top": ("max", "v"), "total": ("sum", "v"), "n": ("count", F.col("v") > 5)}
    schema = "k string, ts timestamp, ord int, v int"
    want = None
    for seconds, data in ((60, rows), (3600, rows[::-1]), (10 ** 9, rows[1::2] + rows[::2])):
        df = spark.createDataFrame(data, schema)
        got = sorted(tuple(r) for r in prior(df, ["k"], ["ts", "ord"], specs, time_chunk("ts", seconds)).select("ord", *specs).collect())
        want = want or got
        assert got == want
    by = sorted((r for r in rows if r[0] == "k"), key=lambda r: (r[1], r[2]))
    seen = {}
    for i, r in enumerate(by):
        before = by[:i]
        evens = [b[3] for b in before if b[3] % 2 == 0]
        seen[r[2]] = (evens[-1] if evens else None, max((b[3] for b in before), default=None), sum(b[3] for b in before), sum(b[3] > 5 for b in before))
    assert all(tuple(g[1:]) == seen[g[0]] for g in want if g[0] in seen)
