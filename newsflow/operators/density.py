"""Density topics (C03) and the sweep over settings.

Clusters of a bucket are the leaves of its density tree: rows are linked by the larger of their
distance and their two core distances (the distance to the ``samples``-th nearest other row);
along the minimum spanning tree of these links, components grow from the shortest link on; one
that reaches ``least`` rows is a cluster until it meets another cluster. What joins a cluster
before that belongs to it, what doesn't is noise, and noise goes to the similarity components
(C04). Vectors are scaled to unit length, so the order of distances is that of cosines; there
is no projection to fewer dimensions before.

No task holds a bucket:

* rows are dealt into parts of ``together``, and a task compares two parts: it yields core
  distances and the links between them that the spanning tree of both has, which are all links
  of the whole tree that lie between the two parts;
* where a bucket has several parts, their forests are thinned in groups of a fixed number, then
  by bucket, or in Borůvka rounds over tables where a bucket has more than a range of links;
* the tree's links are taken in ranges of ascending length; a task takes one range of a bucket,
  with the components that its links touch (those below ``least`` rows with their members, the
  others by name alone).

The work is that of all pairs of a bucket, in blocks, as exact core distances need it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.operators.clustering import _unit, _vectors, config_score, numbered_rows, similarity_clusters
from newsflow.operators.components import components
from newsflow.operators.ordering import placed
from newsflow.session import shared_folder

#: Rows of a part, links of a range of the tree, parts on a side whose forests are thinned together.
TOGETHER, RANGE, FAN = 2048, 500_000, 8
SMALL, CLUSTER, SPLIT = 0, 1, 2


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit (or zero) vectors; rounded, so that equal vectors are at distance zero."""
    return np.maximum(np.round((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 10), 0)


def spanning_forest(weight: np.ndarray) -> list[tuple[int, int, float]]:
    """Prim's algorithm on a symmetric matrix, infinite where there is no link; of equal links that of the least rows comes first."""
    n = len(weight)
    best, code, source, inside = np.full(n, np.inf), np.full(n, n * n), np.zeros(n, np.int64), np.zeros(n, bool)
    at, out, every = 0, [], np.arange(n)
    for _ in range(n - 1):
        inside[at] = True
        own = np.minimum(every, at) * n + np.maximum(every, at)
        nearer = ~inside & ((weight[at] < best) | ((weight[at] == best) & (own < code)))
        best[nearer], code[nearer], source[nearer] = weight[at][nearer], own[nearer], at
        shown = np.where(inside, np.inf, best)
        least = shown.min()
        ties = np.flatnonzero((shown == least) & ~inside)
        at = int(ties[code[ties].argmin()])
        if least < np.inf:
            out.append((int(source[at]), at, float(least)))
    return out


def _halved(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minus half of the squared distances between unit (or zero) vectors, as one matrix product."""
    size = lambda u: (u * u).sum(axis=1)[:, None] / 2
    one = lambda u: np.ones((len(u), 1))
    return np.hstack([left, -size(left), one(left)]) @ np.hstack([right, one(right), -size(right)]).T


def _squared(halved: np.ndarray) -> np.ndarray:
    """As squared_distances gives them."""
    return np.maximum(np.round(-2 * halved, 10), 0)


def _pairs(rows: DataFrame, *columns: str):
    """rows(b, part, parts, ...) once for each pair of two parts that their own belongs to, as groups."""
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("part")))
    both = rows.where("parts > 1").select("b", "part", *columns, other.alias("other"))
    return both.select("b", "part", *columns, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).groupBy("b", "low", "high")


def core_distances(rows: DataFrame, samples: Sequence[int]) -> DataFrame:
    """rows as numbered_rows gives them, with cores: an array of squared core distances, one for each number of samples. In a bucket of fewer rows the farthest counts, a single row has 0.

    A row's nearest ones in its own part bound its core distance; of other parts only what is
    nearer than that bound leaves the task.
    """
    most = max(samples)

    def nearest(part: pd.DataFrame) -> pd.DataFrame:
        unit = _unit(_vectors(part))
        distance = squared_distances(unit, unit)
        np.fill_diagonal(distance, np.inf)
        least = np.sort(np.partition(distance, min(most, len(part)) - 1, axis=1)[:, :most], axis=1)
        return part[["b", "place", "part", "parts", "embedding"]].assign(near=[x[np.isfinite(x)].tolist() for x in least])

    def nearer(key: tuple, pair: pd.DataFrame) -> pd.DataFrame:
        left, right = pair[pair["part"] == key[1]], pair[pair["part"] == key[2]]
        # distances have ten digits: what is nearer than the bound is so by a unit of the last
        reach = [-x["bound"].to_numpy(float) / 2 + 2e-11 for x in (left, right)]
        halved = _halved(_unit(_vectors(left)), _unit(_vectors(right)))
        out = []
        for mine, hits in ((left, halved > reach[0][:, None]), (right, (halved > reach[1][None, :]).T)):
            i, j = np.nonzero(hits)
            d = _squared(halved[i, j] if mine is left else halved[j, i])
            order = np.lexsort((d, i))
            i, d = i[order], d[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < most
            i, d = i[kept], d[kept]
            rows_, starts = np.unique(i, return_index=True)
            near = [x.tolist() for x in np.split(d, starts[1:])] if len(i) else []
            out.append(pd.DataFrame({"b": key[0], "place": mine["place"].to_numpy()[rows_], "near": pd.Series(near, dtype=object)}))
        return pd.concat(out)

    own = rows.select("b", "place", "part", "parts", "embedding").groupBy("b", "part").applyInPandas(nearest, "b string, place long, part int, parts int, embedding array<double>, near array<double>").checkpoint()
    bound = F.when(F.size("near") >= most, F.element_at("near", most)).otherwise(F.lit(float("inf")))
    found = own.select("b", "place", "near").unionByName(_pairs(own.withColumn("bound", bound), "place", "embedding", "bound").applyInPandas(nearer, "b string, place long, near array<double>"))
    near = F.array_sort(F.flatten(F.collect_list("near")))
    pick = lambda k: F.coalesce(F.try_element_at("near", F.least(F.lit(k), F.size("near"))), F.lit(0.0))
    cores = found.groupBy("b", "place").agg(near.alias("near")).select("b", "place", F.array(*[F.when(F.size("near") > 0, pick(k)).otherwise(0.0) for k in samples]).alias("cores"))
    return rows.join(cores, ["b", "place"])


class Sets:
    """Disjoint sets of 0 .. n - 1."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the links, one after the other, connect two sets; they are joined."""
        kept, at, size = [], 0, max(1024, len(self.label))
        while at < len(x):
            a, b = self.label[x[at : at + size]], self.label[y[at : at + size]]
            apart = np.flatnonzero(a != b)
            root = self.label.tolist()
            for k, i, j in zip((apart + at).tolist(), a[apart].tolist(), b[apart].tolist(), strict=True):
                while root[i] != i:
                    root[i] = i = root[root[i]]
                while root[j] != j:
                    root[j] = j = root[root[j]]
                if i != j:
                    root[max(i, j)] = min(i, j)
                    kept.append(k)
            self.label = np.array(root, np.int64)
            while (self.label != self.label[self.label]).any():
                self.label = self.label[self.label]
            at, size = at + size, size * 2
        return np.array(kept, np.int64)


def least_forest(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which links(x, y, w) are of the minimum spanning forest; equal ones in the order of x, then y."""
    order = np.lexsort((y, x, w))
    code = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
    return order[Sets(int(code.max()) + 1 if len(code) else 0).add(code[: len(x)][order], code[len(x) :][order])]


def crossing(halved: np.ndarray, left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """halved distances between two parts, their core distances, and links(x, y, w) of both parts' own trees (rows of the right one are numbered behind those of the left one) -> x, y, w of the links between the parts in the minimum spanning tree of both.

    Links are taken by bands of rising length. Rows that are connected already don't meet, so
    after the first band only rows outside of the largest component are compared.
    """
    n = len(left)
    sets, low, out = Sets(n + len(right)), -np.inf, []
    levels = [*np.unique(np.quantile(w, [0.1, 0.5, 0.8, 0.95, 1.0], method="higher")), None] if len(w) else [None]
    for high in levels:
        label = sets.label
        sizes = np.bincount(label)
        if sizes.max() == len(label):
            break
        if high is None:  # both parts are whole: the shortest link between them
            high = np.maximum(np.maximum(_squared(halved), left[:, None]), right[None, :]).min()
        rest = label != sizes.argmax()
        every_i, every_j = np.flatnonzero(left <= high), np.flatnonzero(right <= high)
        found = []
        for i, j in ((every_i[rest[every_i]], every_j), (every_i[~rest[every_i]], every_j[rest[n + every_j]])):
            some = halved if len(i) == n and len(j) == len(right) else halved[np.ix_(i, j)]
            a, b = np.nonzero(some >= -high / 2 - 1e-9)
            found.append((i[a], j[b]))
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        apart = label[i] != label[n + j]
        i, j = i[apart], j[apart]
        length = np.maximum(np.maximum(_squared(halved[i, j]), left[i]), right[j])
        fit, own = (length > low) & (length <= high), np.flatnonzero((w > low) & (w <= high))
        i, j, length = i[fit], j[fit], length[fit]
        ax, ay, aw = np.concatenate([i, x[own]]), np.concatenate([n + j, y[own]]), np.concatenate([length, w[own]])
        order = np.lexsort((ay, ax, aw))
        kept = order[sets.add(ax[order], ay[order])]
        kept = kept[kept < len(i)]
        out.append((i[kept], n + j[kept], length[kept]))
        low = high
    return tuple(np.concatenate([o[k] for o in out]) for k in (0, 1, 2)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def spanning_tree(rows: DataFrame, most: int = RANGE) -> DataFrame:
    """rows with core (squared) -> b, x, y, w: the links of each bucket's minimum spanning tree, w squared. Equal links are ordered by x, then y."""
    return spanning_trees(rows.withColumn("cores", F.array("core")), 1, most).select("b", "x", "y", "w")


LINKS = "k int, b string, low int, high int, parts int, x long, y long, w double"


def spanning_trees(rows: DataFrame, n: int, most: int = RANGE) -> DataFrame:
    """rows with n cores -> k, b, x, y, w: the tree of each bucket by the k-th core distances, for all k at once.

    A part's own tree comes first; two parts yield the links between them that their common tree
    has. The forests of up to FAN x FAN pairs of parts are thinned together, then what a bucket
    has left is one task if it is no more than ``most`` links, else Borůvka rounds choose.
    """

    def own(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        unit, place, cores = _unit(_vectors(part)), part["place"].to_numpy(), np.array(part["cores"].tolist(), float)
        distance = squared_distances(unit, unit)
        np.fill_diagonal(distance, np.inf)
        out = []
        for k in range(n):
            core = cores[:, k]
            found = np.array(spanning_forest(np.maximum(distance, np.maximum(core[:, None], core[None, :]))), float).reshape(-1, 3)
            x, y = place[found[:, 0].astype(int)], place[found[:, 1].astype(int)]
            out.append(pd.DataFrame({"k": k, "x": np.minimum(x, y), "y": np.maximum(x, y), "w": found[:, 2]}))
        first = part.iloc[0]
        return pd.concat(out).assign(b=first["b"], low=first["part"], high=first["part"], parts=first["parts"])

    def between(key: tuple, pair: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("place")
        unit, place, cores = _unit(_vectors(pair)), pair["place"].to_numpy(), np.array(pair["cores"].tolist(), float)
        m = int((pair["part"] == key[1]).sum())  # places of the lower part come first
        halved, out = _halved(unit[:m], unit[m:]), []
        for k in range(n):
            tree = trees[trees["k"] == k]
            x, y = (np.searchsorted(place, tree[c].to_numpy()) for c in ("x", "y"))
            x, y, w = crossing(halved, cores[:m, k], cores[m:, k], x, y, tree["w"].to_numpy(float))
            out.append(pd.DataFrame({"k": k, "x": place[x], "y": place[y], "w": w}))
        return pd.concat(out).assign(b=key[0], low=key[1], high=key[2], parts=pair["parts"].iloc[0])

    def thinned(links: pd.DataFrame) -> pd.DataFrame:
        links = links.reset_index(drop=True)
        return links.iloc[least_forest(*(links[c].to_numpy() for c in ("x", "y", "w")))]

    trees = rows.select("b", "place", "part", "parts", "embedding", "cores").groupBy("b", "part").applyInPandas(own, LINKS).checkpoint()
    done, open_ = trees.where("parts = 1").select("k", "b", "x", "y", "w"), trees.where("parts > 1")
    if open_.isEmpty():
        return done
    sides = _pairs(rows, "place", "parts", "embedding", "cores").cogroup(_pairs(trees.withColumnRenamed("low", "part").drop("high"), "k", "x", "y", "w"))
    links = open_.unionByName(sides.applyInPandas(between, LINKS))
    group = [F.floor(F.col(c) / FAN).alias(f"_{c}") for c in ("low", "high")]
    links = links.groupBy("k", "b", *group).applyInPandas(thinned, LINKS).select("k", "b", "x", "y", "w").checkpoint()
    large = links.groupBy("k", "b").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("k", "b", F.lit(True).alias("_large"))
    marked = links.join(large, ["k", "b"], "left")
    done = done.unionByName(marked.where("_large is null").select("k", "b", "x", "y", "w").groupBy("k", "b").applyInPandas(thinned, "k int, b string, x long, y long, w double"))
    if large.isEmpty():
        return done
    chosen = boruvka(marked.where("_large").select(F.concat_ws(":", "k", "b").alias("b"), "x", "y", "w"))
    return done.unionByName(chosen.select(F.substring_index("b", ":", 1).cast("int").alias("k"), F.expr("substr(b, instr(b, ':') + 1)").alias("b"), "x", "y", "w"))


def boruvka(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """links(b, x, y, w) -> those of the minimum spanning forest. In each round every component takes its least link."""
    chosen, open_ = [], links.withColumns({"cx": F.col("x"), "cy": F.col("y")})
    for _ in range(most_rounds):
        both = open_.withColumns({"c": F.col("cx"), "o": F.col("cy")}).unionByName(open_.withColumns({"c": F.col("cy"), "o": F.col("cx")}))
        least = both.groupBy("b", "c").agg(F.min(F.struct("w", "x", "y", "o")).alias("e")).select("b", "c", "e.*").checkpoint()
        if least.isEmpty():
            out = chosen[0]
            for part in chosen[1:]:
                out = out.unionByName(part)
            return out.distinct()
        chosen.append(least.select("b", "x", "y", "w"))
        found = components(least.select(F.struct("b", "c").alias("a"), F.struct(F.col("b"), F.col("o").alias("c")).alias("b"))).select(F.col("node.b").alias("b"), F.col("node.c").alias("c"), F.col("root.c").alias("r"))
        for side in ("cx", "cy"):
            new = found.select("b", F.col("c").alias(side), F.col("r").alias("_r"))
            open_ = open_.join(new, ["b", side], "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
        open_ = open_.where("cx <> cy").checkpoint()
    raise RuntimeError(f"the tree did not close in {most_rounds} rounds")


#: What a range leaves: rows that came into a cluster, and components with their new name and state.
GROWN = "b string, what string, id long, cluster long, w double, root long, kind int, members array<long>"


def tree_cut(tree: DataFrame, least: int, most: int = RANGE) -> DataFrame:
    """tree(b, x, y, w) -> b, place, cluster, w: rows in clusters of the tree's leaves, and at which w they came in. A cluster's name is its least first member; a bucket without two clusters has none.

    Ranges of ``most`` links follow each other; afterwards the links that are left go on from
    the components that have grown, with their states.
    """
    alone = lambda c: F.struct(F.lit(SMALL).alias("kind"), F.lit(None).cast("long").alias("cluster"), F.array(c).alias("members"))
    links = placed(tree, "b", "w", "x", "y").select("b", "w", "place", F.floor(F.col("place") / most).alias("range"), F.col("x").alias("cx"), F.col("y").alias("cy"), alone("x").alias("sx"), alone("y").alias("sy")).checkpoint()

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        state, root, rows = {}, {}, []

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for w, *ends in part[["w", "cx", "kx", "ux", "mx", "cy", "ky", "uy", "my"]].itertuples(index=False):
            for c, kind, cluster, members in (ends[:4], ends[4:]):
                if c not in root:
                    root[c], state[c] = c, (int(kind), None if pd.isna(cluster) else int(cluster), [] if members is None else list(members))
            a, b = find(ends[0]), find(ends[4])
            (ka, ua, ma), (kb, ub, mb) = state[a], state[b]
            if ka == kb == SMALL:
                members = ma + mb
                new = (SMALL, None, members)
                if len(members) >= least:
                    new = (CLUSTER, min(members), [])
                    rows += [("row", m, new[1], w, None, None, None) for m in members]
            elif {ka, kb} == {SMALL, CLUSTER}:
                new = (CLUSTER, ua if ka == CLUSTER else ub, [])
                rows += [("row", m, new[1], w, None, None, None) for m in (mb if ka == CLUSTER else ma)]
            else:
                new = (SPLIT, None, [])
            root[b], state[a] = a, new
        for c in root:
            kind, cluster, members = state[find(c)]
            rows.append(("component", c, cluster, None, find(c), kind, members))
        out = pd.DataFrame(rows, columns=["what", "id", "cluster", "w", "root", "kind", "members"]).assign(b=part["b"].iloc[0])
        return out.astype({"cluster": "Int64", "root": "Int64", "kind": "Int32"})

    flat = lambda df: df.select("b", "w", "place", "range", "cx", F.col("sx.kind").alias("kx"), F.col("sx.cluster").alias("ux"), F.col("sx.members").alias("mx"), "cy", F.col("sy.kind").alias("ky"), F.col("sy.cluster").alias("uy"), F.col("sy.members").alias("my"))
    last, found = links.agg(F.max("range")).first()[0], []
    for step in range(0 if last is None else last + 1):
        done = flat(links.where(F.col("range") == step)).groupBy("b").applyInPandas(grow, GROWN).checkpoint()
        found.append(done.where("what = 'row'").select("b", F.col("id").alias("place"), "cluster", "w"))
        links = links.where(F.col("range") > step)
        if step < last:
            for c, s in (("cx", "sx"), ("cy", "sy")):
                new = done.where("what = 'component'").select("b", F.col("id").alias(c), F.col("root").alias("_c"), F.struct("kind", "cluster", "members").alias("_s"))
                links = links.join(new, ["b", c], "left").withColumns({c: F.coalesce("_c", c), s: F.coalesce("_s", s)}).drop("_c", "_s")
            links = links.checkpoint()
    if not found:
        return tree.select("b", F.col("x").alias("place"), F.col("x").alias("cluster"), "w").limit(0)
    rows = found[0]
    for part in found[1:]:
        rows = rows.unionByName(part)
    several = rows.groupBy("b").agg(F.min("cluster").alias("_l"), F.max("cluster").alias("_m")).where("_l < _m").select("b")
    return rows.join(several, "b", "left_semi")


def density_rows(messages: DataFrame, least: int = 5, samples: int = 3, together: int = TOGETHER, most: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(rows, clusters): numbered rows, and of those in clusters of their bucket the label, in the order of the clusters' first rows, and the probability: the least w of the cluster over that of the row, as lengths."""
    shared_folder(messages.sparkSession)
    rows = numbered_rows(messages, together)
    tree = spanning_trees(core_distances(rows, [samples]).checkpoint(), 1, most).select("b", "x", "y", "w")
    return rows, labelled(tree_cut(tree, least, most))


def labelled(cut: DataFrame) -> DataFrame:
    cut = cut.checkpoint()
    names = cut.groupBy("b", "cluster").agg(F.min("place").alias("_first"), F.min("w").alias("_w"))
    names = names.withColumn("label", (F.row_number().over(Window.partitionBy("b").orderBy("_first")) - 1).cast("int"))
    probability = F.when(F.col("w") == 0, 1.0).otherwise(F.sqrt(F.col("_w") / F.col("w")))
    return cut.join(names, ["b", "cluster"]).select("b", "place", "label", probability.alias("probability"))


def density_topics(messages: DataFrame, least: int = 5, samples: int = 3, together: int = TOGETHER, most: int = RANGE) -> DataFrame:
    """(C03) messages(bucket, event_id, event_timestamp, embedding) -> bucket, event_id, label within the bucket, probability, first, strategy of the bucket.

    Strategies: density, mixed (noise went to similarity components, whose labels come after
    the clusters'), similarity (a bucket of fewer than ``least`` rows, or without two clusters).
    Defined results: a null bucket is a bucket of its own; rows that repeat an id are rows of
    their own; a null or zero vector is at distance 1 from all others; an empty table has no row.
    """
    dims = F.coalesce(F.size(F.first("embedding", ignorenulls=True)), F.lit(0))
    missing = messages.agg(dims.alias("d"), F.count_if(F.col("embedding").isNull()).alias("n")).first()
    if missing.n:
        messages = messages.withColumn("embedding", F.coalesce(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), max(0, missing.d))))
    rows, clusters = density_rows(messages, least, samples, together, most)
    clusters = clusters.checkpoint()
    counts = clusters.groupBy("b").agg((F.max("label") + 1).alias("n_clusters"))
    begins = rows.groupBy("b").agg(F.min("event_timestamp").alias("first"), F.count("*").alias("_n"))
    full = rows.join(clusters, ["b", "place"], "left").join(counts, "b", "left").join(begins, "b").checkpoint()
    noise = full.where("label is null")
    rest = similarity_clusters(noise.select(F.col("b").alias("bucket"), F.col("place").alias("event_id"), F.col("place").alias("event_timestamp"), "embedding"))
    rest = rest.select(F.col("bucket").alias("b"), F.col("event_id").alias("place"), F.col("label").alias("_label"), F.col("probability").alias("_probability"))
    strategies = noise.groupBy("b").agg(F.lit(True).alias("_noise"))
    strategy = F.when(F.col("n_clusters").isNull(), "similarity").when(F.col("_noise"), "mixed").otherwise("density")
    label = F.coalesce("label", F.col("_label") + F.coalesce("n_clusters", F.lit(0)))
    return full.join(rest, ["b", "place"], "left").join(strategies, "b", "left").select("bucket", "event_id", label.alias("label"), F.coalesce("probability", "_probability").alias("probability"), "first", strategy.alias("strategy"))


def sweep(messages: DataFrame, settings: Sequence[tuple[int, int]], together: int = TOGETHER) -> DataFrame:
    """(C09) settings of (least, samples) -> setting (its place), least, samples, noise_ratio, n_clusters, largest_ratio, score; the best is the first by score.

    One tree for each number of samples, all in one pass over the pairs, cut once for each setting; all rows of a bucket below
    ``least`` rows are noise.
    """
    spark = messages.sparkSession
    shared_folder(spark)
    rows, out = numbered_rows(messages, together), None
    samples = sorted({s for _, s in settings})
    cored = core_distances(rows, samples).checkpoint()
    total = rows.count()
    trees = spanning_trees(cored, len(samples)).checkpoint()
    for k, s in enumerate(samples):
        tree = trees.where(F.col("k") == k).select("b", "x", "y", "w")
        for place, (least, _) in ((i, x) for i, x in enumerate(settings) if x[1] == s):
            sizes = tree_cut(tree, least).groupBy("b", "cluster").agg(F.count("*").alias("n"))
            row = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"), F.count("*").alias("n_clusters"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
            ratio = lambda c: c / F.lit(max(1, total))
            row = row.select(F.lit(place).alias("setting"), F.lit(least).alias("least"), F.lit(s).alias("samples"), ratio(F.lit(total) - F.col("kept")).alias("noise_ratio"), "n_clusters", ratio(F.col("most")).alias("largest_ratio"))
            out = row if out is None else out.unionByName(row)
    return out.withColumn("score", config_score(F.col("largest_ratio"), F.col("noise_ratio"), F.col("n_clusters")))
