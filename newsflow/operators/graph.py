"""Topic graphs (N01-N16): channels and entities, their centralities, communities and bridges.

Building and counting are joins and aggregations. Measures of a whole graph run per topic in
one Arrow group, over lists of neighbours and in time and memory about linear in its edges: a
topic's graph has as many nodes as it has channels and entities, not messages. Betweenness,
which takes a walk from every node, is dealt over tasks by its sources.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bonuses and threshold of the bridge score, damping and rounds of the ranks.
TWO_COMMUNITIES, ARTICULATION, BRIDGE, DAMPING, ROUNDS, SWEEPS = 0.2, 0.3, 0.25, 0.85, 40, 20


def build(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(N01) mentions(cluster, event_id, channel, entity_key, entity_type, entity_text, mention_count) -> nodes, edges."""
    m = mentions.withColumn("ch", F.concat(F.lit("ch-"), "channel")).withColumn("ent", F.concat(F.lit("ent-"), F.upper(F.coalesce("entity_type", F.lit("MISC"))), F.lit(":"), "entity_key"))
    channels = m.groupBy("cluster", F.col("ch").alias("id")).agg(F.max("channel").alias("label"), F.sum("mention_count").cast("double").alias("weight")).withColumn("kind", F.lit("channel"))
    entities = m.groupBy("cluster", F.col("ent").alias("id")).agg(F.max("entity_text").alias("label"), F.sum("mention_count").cast("double").alias("weight")).withColumn("kind", F.lit("entity"))
    says = m.groupBy("cluster", F.col("ch").alias("a"), F.col("ent").alias("b")).agg(F.sum("mention_count").cast("double").alias("weight")).withColumn("kind", F.lit("mentions"))
    per = m.groupBy("cluster", "event_id", "ent").agg(F.sum("mention_count").alias("n"))
    x, y = per.alias("x"), per.alias("y")
    pairs = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.event_id") == F.col("y.event_id")) & (F.col("x.ent") < F.col("y.ent")))
    together = pairs.groupBy(F.col("x.cluster").alias("cluster"), F.col("x.ent").alias("a"), F.col("y.ent").alias("b")).agg(F.sum(F.least("x.n", "y.n")).cast("double").alias("weight")).withColumn("kind", F.lit("co_occurs"))
    return channels.unionByName(entities), says.unionByName(together)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(N02, N15) Distinct neighbours over n - 1, and the sum of weights."""
    ends = edges.select("cluster", F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(edges.select("cluster", F.col("b").alias("id"), F.col("a").alias("other"), "weight"))
    d = ends.groupBy("cluster", "id").agg(F.countDistinct("other").alias("degree"), F.sum("weight").alias("weighted_degree"))
    n = nodes.groupBy("cluster").agg(F.count("*").alias("n"))
    out = nodes.select("cluster", "id").join(d, ["cluster", "id"], "left").join(n, "cluster")
    return out.select("cluster", "id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"), (F.coalesce("degree", F.lit(0)) / F.greatest(F.col("n") - 1, F.lit(1))).alias("degree_centrality"))


@dataclass(frozen=True)
class Links:
    """A graph as lists of neighbours: those of node k are to[start[k] : start[k + 1]], with their weights."""

    start: np.ndarray
    to: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, graph: "Links | np.ndarray") -> "Links":
        """From a matrix of weights, for small graphs."""
        if isinstance(graph, Links):
            return graph
        a, b = np.nonzero(graph)
        return cls.joining(len(graph), a, b, graph[a, b].astype(float))

    @classmethod
    def joining(cls, n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> "Links":
        """Weights of repeated links are added."""
        pair, at = np.unique(a.astype(np.int64) * n + b, return_inverse=True)
        return cls(np.searchsorted(pair, np.arange(n + 1) * n), pair % n if n else pair, np.bincount(at, weight, len(pair)))

    @property
    def n(self) -> int:
        return len(self.start) - 1

    @property
    def degree(self) -> np.ndarray:
        return np.diff(self.start)

    @property
    def of_node(self) -> np.ndarray:
        """The node that each place of ``to`` belongs to."""
        return np.repeat(np.arange(self.n), self.degree)

    def around(self, k: int) -> np.ndarray:
        return self.to[self.start[k] : self.start[k + 1]]

    def steps(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All links (from, to) that leave the nodes."""
        size = self.degree[nodes]
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(nodes, size), self.to[np.repeat(self.start[nodes], size) + offset]


def page_rank(w: Links | np.ndarray) -> np.ndarray:
    """(N04) ROUNDS steps of the weighted walk; mass of nodes without edges is spread."""
    g = Links.of(w)
    n, at = g.n, g.of_node
    out = np.bincount(at, g.weight, n)
    share = g.weight / out[at]
    rank = np.full(n, 1 / max(n, 1))
    for _ in range(ROUNDS):
        rank = (1 - DAMPING) / n + DAMPING * (np.bincount(g.to, rank[at] * share, n) + rank[out == 0].sum() / n)
    return rank


def passed(g: Links, sources: np.ndarray) -> np.ndarray:
    """Shares of shortest paths from the sources that run through each node, layer by layer; one source after the other."""
    total = np.zeros(g.n)
    for s in sources.tolist():
        paths, layer = np.zeros(g.n), np.full(g.n, -1)
        paths[s], layer[s] = 1, 0
        steps, front = [], np.array([s])
        while len(front):
            a, b = g.steps(front)
            layer[b[layer[b] < 0]] = len(steps) + 1
            on = layer[b] == len(steps) + 1
            a, b = a[on], b[on]
            np.add.at(paths, b, paths[a])
            steps.append((a, b))
            front = np.unique(b)
        share = np.zeros(g.n)
        for a, b in reversed(steps):
            np.add.at(share, a, paths[a] / paths[b] * (1 + share[b]))
        share[s] = 0
        total += share
    return total


def betweenness(linked: Links | np.ndarray) -> np.ndarray:
    """(N03)"""
    g = Links.of(linked)
    return passed(g, np.arange(g.n)) / max((g.n - 1) * (g.n - 2), 1)


def communities(w: Links | np.ndarray) -> np.ndarray:
    """(N05) Label propagation in the order of the nodes; ties go to the lowest label."""
    g = Links.of(w)
    label = np.arange(g.n)
    for _ in range(SWEEPS):
        before = label.copy()
        for k in np.flatnonzero(g.degree).tolist():
            near, at = np.unique(label[g.around(k)], return_inverse=True)
            label[k] = near[np.bincount(at, g.weight[g.start[k] : g.start[k + 1]]).argmax()]
        if (label == before).all():
            break
    return np.unique(label, return_inverse=True)[1]


def component_labels(linked: Links | np.ndarray) -> np.ndarray:
    """(N06) Every node takes the least label around it, then that node's label."""
    g = Links.of(linked)
    label, at = np.arange(g.n), g.of_node
    while True:
        less = label.copy()
        np.minimum.at(less, g.to, label[at])
        less = less[less]
        if (less == label).all():
            return np.unique(label, return_inverse=True)[1]
        label = less


def articulation(linked: Links | np.ndarray) -> np.ndarray:
    """(N07) Nodes whose neighbours fall apart without them, by one depth-first walk: nothing below a child reaches above the node."""
    g = Links.of(linked)
    seen, low, out = np.full(g.n, -1), np.zeros(g.n, np.int64), np.zeros(g.n, bool)
    clock = 0
    for root in range(g.n):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = clock
        clock += 1
        walk, children = [(root, -1, iter(g.around(root).tolist()))], 0
        while walk:
            k, parent, others = walk[-1]
            down = next((b for b in others if b != parent), None)
            if down is None:
                walk.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[k])
                    if parent == root:
                        children += 1
                    elif low[k] >= seen[parent]:
                        out[parent] = True
            elif seen[down] >= 0:
                low[k] = min(low[k], seen[down])
            else:
                seen[down] = low[down] = clock
                clock += 1
                walk.append((down, k, iter(g.around(down).tolist())))
        out[root] = children > 1
    return out


def _numbered(links: pd.DataFrame, names: list[str]) -> Links:
    place = {name: k for k, name in enumerate(names)}
    a, b = links["a"].map(place).to_numpy(int), links["b"].map(place).to_numpy(int)
    w = links["weight"].to_numpy(float)
    return Links.joining(len(names), np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]))


def _topic_betweenness(nodes: DataFrame, edges: DataFrame, together: int) -> DataFrame:
    """nodes(cluster, id), edges(cluster, a, b, weight) -> cluster, id, betweenness of nodes with edges. The sources of a topic are dealt into parts of about so many; each part gets the topic's edges."""
    size = nodes.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / together).cast("int"))
    dealt = edges.join(size.select("cluster", "parts"), "cluster").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def one(key: tuple, links: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(links["a"]) | set(links["b"]))
        parts = int(links["parts"].iloc[0])
        own = np.array([k for k, name in enumerate(names) if zlib.crc32(name.encode()) % parts == key[1]], int)
        return pd.DataFrame({"cluster": key[0], "id": names, "passed": passed(_numbered(links, names), own)})

    found = dealt.groupBy("cluster", "part").applyInPandas(one, "cluster string, id string, passed double").groupBy("cluster", "id").agg(F.sum("passed").alias("passed"))
    return found.join(size, "cluster").select("cluster", "id", (F.col("passed") / F.greatest((F.col("n") - 1) * (F.col("n") - 2), F.lit(1))).alias("betweenness"))


MEASURES = ("cluster", "id", "degree_centrality", "betweenness", "pagerank", "community", "component", "articulation", "bridge_score", "is_bridge")


def measures(nodes: DataFrame, edges: DataFrame, together: int = 256) -> DataFrame:
    """(N02-N08) All measures of all topics. What takes a walk from every node is dealt (``_topic_betweenness``)."""

    def one(key: tuple, ids: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        names = sorted(ids["id"])
        g = _numbered(links, names)
        group = communities(g)
        around = np.array([len(np.unique(group[g.around(k)])) for k in range(g.n)], int)
        return pd.DataFrame({
            "cluster": key[0], "id": names, "degree_centrality": g.degree / max(g.n - 1, 1), "pagerank": page_rank(g), "community": group,
            "component": component_labels(g), "articulation": articulation(g), "around": around,
        })

    # both come from the same mentions: fresh names for their columns
    own = lambda df, *names: df.select(*(F.col(c).alias(c) for c in names))
    nodes, edges = own(nodes, "cluster", "id"), own(edges, "cluster", "a", "b", "weight")
    linear = nodes.groupBy("cluster").cogroup(edges.groupBy("cluster")).applyInPandas(one, "cluster string, id string, degree_centrality double, pagerank double, community int, component int, articulation boolean, around int")
    out = linear.join(_topic_betweenness(nodes, edges, together), ["cluster", "id"], "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))
    raw = bridge_total(F.col("betweenness"), F.col("around"), F.col("articulation"))
    return out.withColumns({"bridge_score": F.least(F.lit(1.0), raw), "is_bridge": raw >= BRIDGE}).select(*MEASURES)


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(N09)"""
    n, m = nodes.groupBy("cluster").agg(F.count("*").alias("n")), edges.groupBy("cluster").agg(F.count("*").alias("m"))
    j = n.join(m, "cluster", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    density = F.when(F.col("n") < 2, 0.0).otherwise(2 * F.col("m") / (F.col("n") * (F.col("n") - 1)))
    return j.select("cluster", F.col("n").alias("node_count"), F.col("m").alias("edge_count"), density.alias("density"), (2 * F.col("m") / F.col("n")).alias("average_degree"), ((F.col("n") < 3) | (F.col("m") < 2)).alias("is_small"))


def community_summary(measured: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(N10)"""
    who = measured.select("cluster", "id", "community", "pagerank", "degree_centrality").join(nodes, ["cluster", "id"])
    inside = edges.join(who.select("cluster", F.col("id").alias("a"), F.col("community").alias("ca")), ["cluster", "a"]).join(who.select("cluster", F.col("id").alias("b"), F.col("community").alias("cb")), ["cluster", "b"])
    inside = inside.where("ca = cb").groupBy("cluster", F.col("ca").alias("community")).agg(F.count("*").alias("edge_count"))
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("pagerank")).alias("p"), (-F.col("degree_centrality")).alias("d"), "label"))), 1, 5)
    g = who.groupBy("cluster", "community").agg(F.count("*").alias("node_count"), F.count_if(F.col("kind") == "entity").alias("entity_count"), F.count_if(F.col("kind") == "channel").alias("channel_count"), F.transform(first, lambda x: x["label"]).alias("top"))
    return g.join(inside, ["cluster", "community"], "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))


def pmi_edges(mentions: DataFrame, least: int = 3) -> DataFrame:
    """(N14) Pairs of entities in the same message at least ``least`` times with non-negative mutual information."""
    per = mentions.select("event_id", "entity_key").distinct()
    total = per.select("event_id").distinct().agg(F.count("*").alias("total"))
    single = per.groupBy("entity_key").agg(F.count("*").alias("n"))
    x, y = per.alias("x"), per.alias("y")
    both = x.join(y, (F.col("x.event_id") == F.col("y.event_id")) & (F.col("x.entity_key") < F.col("y.entity_key"))).groupBy(F.col("x.entity_key").alias("a"), F.col("y.entity_key").alias("b")).agg(F.count("*").alias("both"))
    j = both.where(F.col("both") >= least).join(single.select(F.col("entity_key").alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col("entity_key").alias("b"), F.col("n").alias("nb")), "b").join(total)
    return j.withColumn("pmi", F.log(F.col("both") * F.col("total") / (F.col("na") * F.col("nb")))).where("pmi >= 0").select("a", "b", "both", "pmi")


def theme_mentions(mentions: DataFrame, least: int = 3) -> DataFrame:
    """(N14) Entity counts by theme times ln((1 + themes) / (1 + themes with it)) + 1."""
    n = mentions.groupBy("cluster", "entity_key").agg(F.count("*").alias("n"))
    df = n.groupBy("entity_key").agg(F.count("*").alias("df"))
    themes = n.agg(F.countDistinct("cluster").alias("themes"))  # one row
    idf = F.log((1 + F.col("themes")) / (1 + F.col("df"))) + 1
    return n.where(F.col("n") >= least).join(df, "entity_key").join(themes).select("cluster", "entity_key", "n", (F.col("n") * idf).alias("weight"))


def two_hops(edges: DataFrame, seeds: DataFrame, least: float = 3) -> DataFrame:
    """(N16) Nodes within two strong edges of the seeds."""
    e = edges.where(F.col("weight") >= least)
    e = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    one = e.join(seeds.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
    two = e.join(one.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
    return one.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2))).groupBy("id").agg(F.min("hops").alias("hops")).join(seeds.select("id"), "id", "left_anti")


def bridge_total(between: Column, communities_around: Column, cut: Column) -> Column:
    """(N08) Betweenness with bonuses for neighbours in two communities and for articulation points."""
    return between + F.when(communities_around >= 2, TWO_COMMUNITIES).otherwise(0.0) + F.when(cut, ARTICULATION).otherwise(0.0)


def bridge_score(between: Column, communities_around: Column, cut: Column) -> Column:
    """(N08) The total as shown, up to 1."""
    return F.least(F.lit(1.0), bridge_total(between, communities_around, cut))


def ranked(measured: DataFrame, *keys: str) -> DataFrame:
    """(W08) measured(cluster, pagerank, degree_centrality, label) with the place of each node in its topic (and in keys)."""
    w = Window.partitionBy("cluster", *keys).orderBy(F.desc("pagerank"), F.desc("degree_centrality"), "label", "id")
    return measured.withColumn("rank", F.row_number().over(w))


def top_nodes(measured: DataFrame, most: int = 10) -> DataFrame:
    """(N11) The first entities and channels of each topic."""
    return ranked(measured, "kind").where(F.col("rank") <= most)


def top_bridges(measured: DataFrame, most: int = 10) -> DataFrame:
    """(N11) The first bridges of each topic."""
    w = Window.partitionBy("cluster").orderBy(F.desc("bridge_score"), F.desc("betweenness"), "label", "id")
    return measured.where("is_bridge").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
