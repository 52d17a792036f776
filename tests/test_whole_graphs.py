"""Queries that run on a whole graph, not on the sixteenth of g_sparse."""

import os

import pytest

from edgeloom import catalogue

TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_ball_and_reordered_ranks_take_all_orders(spark, monkeypatch):
    asked, graph = [], catalogue.graph
    monkeypatch.setattr(catalogue, "graph", lambda s, d, name: asked.append(name) or graph(s, d, name))
    first = min(catalogue.QUERIES["hyperball_estimate"](spark, TABLES).collect(), key=lambda r: r["t"])
    assert abs(first["pairs"] - graph(spark, TABLES, "g_cc").vertices.count()) < 5
    assert [r["valid"] for r in catalogue.QUERIES["pagerank_reordered_valid"](spark, TABLES).collect()] == [1]
    assert asked == ["g_cc", "g_cc"]
