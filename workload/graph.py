"""Dense ids, edges and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.operators import graph
from seamark.plans import neighbourhood, task
from workload.base import HUB, NTH, hub_hour, in_hour, query, r6, Source
from workload.firsts import TASK
from workload.profiles import activity

IDS = "ids AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS node_id FROM customer)"


@query("rekey_dense", f"WITH {IDS} SELECT event_id, ts, node_id AS user_id FROM events LEFT JOIN ids ON c_custkey = user_id")
def rekey_dense(t: Source) -> DataFrame:
    ids = graph.dense_ids(t.customer, "c_custkey")
    return graph.rekey(t.events.select("event_id", "ts", "user_id"), "user_id", ids, "c_custkey")


@query(
    "dense_text_ids",
    "SELECT text, row_number() OVER (ORDER BY text) - 1 AS node_id FROM (SELECT DISTINCT text FROM conversations)",
)
def dense_text_ids(t: Source) -> DataFrame:
    return graph.dense_ids(t.conversations, "text")


@query(
    "sparse_key_ids",
    """
SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS node_id
FROM (SELECT DISTINCT l_partkey * l_partkey AS l_partkey FROM lineitem)
""",
)
def sparse_key_ids(t: Source) -> DataFrame:
    """Keys with ever wider gaps."""
    return graph.dense_ids(t.lineitem.select((F.col("l_partkey") * F.col("l_partkey")).alias("l_partkey")), "l_partkey")


@query(
    "dense_url_ids",
    "SELECT url, row_number() OVER (ORDER BY url) - 1 AS node_id FROM (SELECT DISTINCT url FROM pages)",
)
def dense_url_ids(t: Source) -> DataFrame:
    """Keys that all begin alike."""
    return graph.dense_ids(t.pages, "url")


@query(
    "dense_ids_outlier",
    """
SELECT k, row_number() OVER (ORDER BY k) - 1 AS node_id
FROM (SELECT DISTINCT CASE WHEN event_id = 7 THEN 4611686018427387904 ELSE event_id END AS k FROM events)
""",
)
def dense_ids_outlier(t: Source) -> DataFrame:
    """One key far from all others."""
    keys = t.events.select(F.when(F.col("event_id") == 7, F.lit(1 << 62)).otherwise(F.col("event_id")).alias("k"))
    return graph.dense_ids(keys, "k")


@query(
    "dense_ids_nested_outliers",
    """
SELECT k, row_number() OVER (ORDER BY k) - 1 AS node_id
FROM (SELECT DISTINCT CASE WHEN event_id = 7 THEN 4611686018427387904 WHEN event_id % 1000 = 3 THEN 1000000000000 + event_id
        ELSE event_id END AS k FROM events)
""",
)
def dense_ids_nested_outliers(t: Source) -> DataFrame:
    """Some keys far from most, and one far from these."""
    id_ = F.col("event_id")
    far = F.when(id_ == 7, F.lit(1 << 62)).when(id_ % 1000 == 3, id_ + 10**12).otherwise(id_)
    return graph.dense_ids(t.events.select(far.alias("k")), "k")


@query(
    "fk_edges",
    "SELECT 'f2p_o_custkey' AS edge_type, o_orderkey AS src, o_custkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey",
)
def fk_edges(t: Source) -> DataFrame:
    return graph.foreign_key_edges(t.orders, "o_orderkey", "o_custkey", t.customer, "c_custkey", "f2p_o_custkey")


@query(
    "rev_edges",
    "SELECT 'rev_f2p_o_custkey' AS edge_type, o_custkey AS src, o_orderkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey",
)
def rev_edges(t: Source) -> DataFrame:
    return graph.reverse_edges(fk_edges(t))


@query(
    "graph_edge_counts",
    f"""
WITH {IDS}, e AS (SELECT 'f2p_user_id' AS edge_type, node_id FROM events JOIN ids ON c_custkey = user_id
  UNION ALL SELECT 'f2p_o_custkey', node_id FROM orders JOIN ids ON c_custkey = o_custkey)
SELECT edge_type, count(*) AS edges, CAST(sum(node_id) AS BIGINT) AS parent_sum FROM e GROUP BY 1
UNION ALL SELECT 'rev_' || edge_type, count(*), CAST(sum(node_id) AS BIGINT) FROM e GROUP BY 1
""",
)
def graph_edge_counts(t: Source) -> DataFrame:
    edges = neighbourhood.graph_edges(activity(t).rekeyed(store=True))
    parent = F.when(F.col("edge_type").startswith("rev_"), F.col("src")).otherwise(F.col("dst"))
    return edges.groupBy("edge_type").agg(F.count("*").alias("edges"), F.sum(parent).alias("parent_sum"))


EDGE_ROWS = """
e AS (SELECT 'f2p_user_id' AS edge_type, 'events' AS child, {event} AS src, {customer_of_event} AS dst
      FROM events {join_event}
  UNION ALL SELECT 'f2p_o_custkey', 'orders', {order}, {customer_of_order} FROM orders {join_order})
SELECT edge_type, child, 'customers' AS parent, src, dst FROM e
UNION ALL SELECT 'rev_' || edge_type, child, 'customers', dst, src FROM e
"""


@query(
    "event_graph_edge_rows",
    f"WITH {IDS}, ev AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS id FROM events), "
    "od AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders), "
    + EDGE_ROWS.format(
        event="ev.id", customer_of_event="node_id", join_event="JOIN ev USING (event_id) JOIN ids ON c_custkey = user_id",
        order="od.id", customer_of_order="node_id", join_order="JOIN od USING (o_orderkey) JOIN ids ON c_custkey = o_custkey",
    ),
)
def event_graph_edge_rows(t: Source) -> DataFrame:
    return neighbourhood.graph_edges(activity(t).rekeyed(store=True))


@query(
    "event_graph_edge_rows_untimed",
    f"WITH {IDS}, "
    + EDGE_ROWS.format(
        event="event_id", customer_of_event="node_id", join_event="JOIN ids ON c_custkey = user_id",
        order="o_orderkey", customer_of_order="node_id", join_order="JOIN ids ON c_custkey = o_custkey",
    ),
)
def event_graph_edge_rows_untimed(t: Source) -> DataFrame:
    """Rows of timed tables keep their own ids."""
    return neighbourhood.graph_edges(activity(t).rekeyed(timed=False, store=True))


@query(
    "event_graph_edge_rows_own_keys",
    "WITH " + EDGE_ROWS.format(
        event="event_id", customer_of_event="c_custkey", join_event="JOIN customer ON c_custkey = user_id",
        order="o_orderkey", customer_of_order="c_custkey", join_order="JOIN customer ON c_custkey = o_custkey",
    ),
)
def event_graph_edge_rows_own_keys(t: Source) -> DataFrame:
    """A database that was not rekeyed: keys without a parent give no edge."""
    return neighbourhood.graph_edges(activity(t))


@query(
    "graph_nodes",
    """
SELECT 'customers' AS type, row_number() OVER (ORDER BY c_custkey) - 1 AS id, NULL::TIMESTAMP AS time FROM customer
UNION ALL SELECT 'events', row_number() OVER (ORDER BY event_id) - 1, ts FROM events
UNION ALL SELECT 'orders', row_number() OVER (ORDER BY o_orderkey) - 1, o_orderdate FROM orders
""",
)
def graph_nodes(t: Source) -> DataFrame:
    return neighbourhood.graph_nodes(activity(t).rekeyed(store=True))


def seeds(t: Source) -> DataFrame:
    return task.nth_distinct_time(t.events, TASK)


@query(
    "latest_k_neighbours",
    f"""
WITH {NTH}
SELECT user_id, nth_time, hop_rank, event_id, ts, value FROM (
  SELECT user_id, nth_time, event_id, ts, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS hop_rank
  FROM nth JOIN events USING (user_id) WHERE ts <= nth_time
) WHERE hop_rank <= 5
""",
)
def latest_k_neighbours(t: Source) -> DataFrame:
    asks = seeds(t).withColumn("seed", F.col("user_id"))
    found = graph.latest_neighbours(
        asks, t.events, 5, seed="seed", key="user_id", seed_time="nth_time", time="ts", row_id="event_id", columns=["value"]
    )
    return found.drop("seed")


@query(
    "neighbours_of_shared_key",
    """
WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders),
j AS (SELECT s.o_orderkey, n.o_orderkey AS near, row_number() OVER (PARTITION BY s.o_orderkey
        ORDER BY n.o_orderdate DESC, CAST(n.o_orderkey AS VARCHAR) DESC) AS hop_rank
      FROM s JOIN orders n ON n.o_custkey = s.o_custkey AND n.o_orderdate <= s.o_orderdate)
SELECT o_orderkey, near, hop_rank FROM j WHERE hop_rank <= 3
""",
)
def neighbours_of_shared_key(t: Source) -> DataFrame:
    """Every order asks for its customer's latest three, so all seeds of a customer share a key."""
    asks = t.orders.select(F.col("o_orderkey").alias("seed"), "o_custkey", F.col("o_orderdate").alias("seed_time"))
    found = graph.latest_neighbours(
        asks, t.orders, 3, seed="seed", key="o_custkey", seed_time="seed_time", time="o_orderdate", row_id="o_orderkey"
    )
    return found.select(F.col("seed").alias("o_orderkey"), F.col("o_orderkey").alias("near"), "hop_rank")


@query(
    "latest_k_hub_hour",
    f"""
WITH {HUB},
s AS (SELECT c_custkey AS seed, c_custkey % 5 AS hub, TIMESTAMP '2024-01-10 10:00:00' + to_seconds(CAST(c_custkey % 9 AS BIGINT)) AS seed_time FROM customer),
j AS (SELECT s.seed, h.event_id, row_number() OVER (PARTITION BY s.seed ORDER BY h.moment DESC, CAST(h.event_id AS VARCHAR) DESC) AS hop_rank
      FROM s JOIN h ON h.hub = s.hub AND h.moment <= s.seed_time)
SELECT seed, event_id, hop_rank FROM j WHERE hop_rank <= 3
""",
)
def latest_k_hub_hour(t: Source) -> DataFrame:
    """All rows of few keys in seven seconds of one hour, for far more rows in an instant than a slice may have."""
    seconds = F.col("c_custkey") % 9
    asks = t.customer.select(F.col("c_custkey").alias("seed"), (F.col("c_custkey") % 5).alias("hub"), in_hour(seconds).alias("seed_time"))
    found = graph.latest_neighbours(
        asks, hub_hour(t), 3, seed="seed", key="hub", seed_time="seed_time", time="moment", row_id="event_id", target=50
    )
    return found.select("seed", "event_id", "hop_rank")


@query(
    "neighbour_mean_features",
    f"""
WITH {NTH},
h1 AS (SELECT * FROM (
  SELECT user_id, nth_time, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS r
  FROM nth JOIN events USING (user_id) WHERE ts <= nth_time) WHERE r <= 3),
h2 AS (SELECT * FROM (
  SELECT h1.user_id, h1.event_id AS node, e.value,
         row_number() OVER (PARTITION BY h1.user_id, h1.event_id ORDER BY e.ts DESC, CAST(e.event_id AS VARCHAR) DESC) AS r
  FROM h1 JOIN events e ON e.event_type = h1.event_type AND e.ts <= h1.nth_time) WHERE r <= 4),
m1 AS (SELECT user_id, count(*) AS n_own, avg(value) AS own_value FROM h1 GROUP BY 1),
m2 AS (SELECT user_id, count(*) AS n_same_type, avg(value) AS same_type_value FROM h2 GROUP BY 1)
SELECT user_id, nth_time, coalesce(n_own, 0) AS n_own, round(own_value, 6) AS own_value,
       coalesce(n_same_type, 0) AS n_same_type, round(same_type_value, 6) AS same_type_value
FROM nth LEFT JOIN m1 USING (user_id) LEFT JOIN m2 USING (user_id)
""",
)
def neighbour_mean_features(t: Source) -> DataFrame:
    """Two hops: a user's last events, then the last events of the same type, where five hubs hold all rows."""
    hops = [
        neighbourhood.Hop("own", t.events, "user_id", "event_id", 3, "ts", ("value",), ("event_type",)),
        neighbourhood.Hop("same_type", t.events, "event_type", "event_id", 4, "ts", ("value",)),
    ]
    found = neighbourhood.neighbourhood_features(seeds(t), hops, "user_id", "nth_time", store=True)
    return found.select(
        "user_id", "nth_time", "n_own", r6("own_value").alias("own_value"), "n_same_type", r6("same_type_value").alias("same_type_value")
    )

