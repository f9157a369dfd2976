"""The edges among what many queries reach over common hubs."""

from tessera.operators import graph
from tests.test_retrieval import _shuffled


def test_edges_are_told_at_the_end_that_fewer_queries_reach(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to send
    suppliers, parts = range(60), range(40)  # each query reaches its own supplier and all parts
    edges = spark.createDataFrame([("CALLS", f"p{p}", f"s{s}", "active", 0.8) for p in parts for s in suppliers], "edge_type string, from_id string, to_id string, status string, confidence double")
    nodes = spark.createDataFrame([(f"{kind}{i}", ["DBTable"], 0.5) for kind, some in (("p", parts), ("s", suppliers)) for i in some], "node_id string, labels array<string>, confidence double")
    seeds = spark.createDataFrame([(s, f"s{s}", ["CALLS"]) for s in suppliers], "query_id long, node_id string, types array<string>")
    before = _shuffled(spark)
    found = graph.ranks(nodes, edges, seeds, 1).collect()
    assert len(found) == 60 * 41 and {r.n_edges for r in found} == {40}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert _shuffled(spark) - before < 100_000  # 144,000 pairs of a query and an edge of a part
