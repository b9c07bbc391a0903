"""Topics from vectors (C01-C10): six-hour buckets, components of the similarity graph, probabilities, run ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions.fingerprints import cosine, jaccard, theme_score
from newsflow.operators.blocks import met
from newsflow.operators.components import components
from newsflow.operators.ordering import placed
from newsflow.session import shared_folder, written

#: Least cosine of a link, bounds of the probability.
LINK, LOW, HIGH = 0.68, 0.55, 0.99
#: Vectors that one task compares; buckets of more are compared in blocks.
TOGETHER = 4096
#: Width of a ring of angles around a pivot, and how many there are up to a half turn.
RING, N_RINGS = np.pi / 36, 37
#: Rounds in which pivots are chosen.
ROUNDS = 4
RINGS = "array<struct<ring: int, low: double, high: double>>"


def bucket_of(ts: Column, hours: int = 6) -> Column:
    """(C02, X32) Begin of the time bucket; buckets restart at midnight."""
    hour = F.hour(ts) - F.hour(ts) % hours
    return (F.date_trunc("day", ts) + F.make_dt_interval(hours=hour)).cast("timestamp_ntz")


def composite_bucket(topic: Column, ts: Column, hours: int = 6) -> Column:
    """(X33) Topic and begin of the time bucket; unknown without topic, NaT without time."""
    begin = F.coalesce(F.date_format(bucket_of(ts, hours), "yyyy-MM-dd HH:mm:ss"), F.lit("NaT"))
    return F.concat_ws("|", F.coalesce(topic, F.lit("unknown")), begin)


def pending(messages: DataFrame, assigned: DataFrame) -> DataFrame:
    """(C01, S06)"""
    return messages.join(assigned.select("event_id"), "event_id", "left_anti")


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; zero stays zero."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def _vectors(part: pd.DataFrame) -> np.ndarray:
    return np.array(part["embedding"].tolist(), np.float64).reshape(len(part), -1)


def _labels(vectors: np.ndarray, least: float) -> np.ndarray:
    """Components of {cosine >= least}, numbered by first appearance; rows are compared in blocks."""
    n, unit = len(vectors), _unit(vectors)
    label, frontier_of, count = np.full(n, -1), [], 0
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed], frontier_of = count, [seed]
        while frontier_of:
            near = (unit[frontier_of[:512]] @ unit.T >= least).any(axis=0) & (label < 0)
            frontier_of = frontier_of[512:] + np.flatnonzero(near).tolist()
            label[near] = count
        count += 1
    return label


def _probabilities(vectors: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(C05) Cosine to the centroid within bounds; 1 alone, 0.75 for a centroid of zero."""
    out, unit = np.ones(len(vectors)), _unit(vectors)
    for k in np.unique(label):
        rows = np.flatnonzero(label == k)
        if len(rows) > 1:
            centre = unit[rows].mean(axis=0)
            size = np.linalg.norm(centre)
            out[rows] = 0.75 if size == 0 else np.clip(unit[rows] @ (centre / size), LOW, HIGH)
    return out


def similarity_clusters(messages: DataFrame, least: float = LINK, together: int = TOGETHER, probabilities: bool = True) -> DataFrame:
    """(C04, C05) messages(bucket, event_id, event_timestamp, embedding) -> bucket, event_id, label within the bucket, probability, first.

    Rows of a bucket are ordered by time, then id. A bucket of up to ``together`` rows is one
    group. A larger one is compared in blocks (``connected``), so that no task holds a bucket; the
    components are those of all pairs. Counting the buckets is a job of its own. Without
    ``probabilities`` those of larger buckets are null.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["event_timestamp", "event_id"], kind="stable")
        vectors = _vectors(part)
        label = _labels(vectors, least)
        return pd.DataFrame({"bucket": part["bucket"], "event_id": part["event_id"], "label": label, "probability": _probabilities(vectors, label), "first": part["event_timestamp"].min()})

    kinds = {c: messages.schema[c].dataType.simpleString() for c in ("bucket", "event_id", "event_timestamp")}
    out = f"bucket {kinds['bucket']}, event_id {kinds['event_id']}, label int, probability double, first {kinds['event_timestamp']}"
    messages = messages.select("bucket", "event_id", "event_timestamp", "embedding")
    sizes = messages.groupBy(F.col("bucket").alias("_bucket")).agg(F.count("*").alias("_n")).where(F.col("_n") > together)
    if sizes.isEmpty():
        return messages.groupBy("bucket").applyInPandas(one, out)
    shared_folder(messages.sparkSession)
    sizes = sizes.withColumn("_large", F.lit(True)).checkpoint()
    dealt = messages.join(sizes.drop("_n"), F.col("bucket").eqNullSafe(F.col("_bucket")), "left").drop("_bucket")
    small = dealt.where("_large is null").drop("_large").groupBy("bucket").applyInPandas(one, out)
    large = _large_clusters(dealt.where("_large").drop("_large"), least, together, probabilities)
    return small.unionByName(large.select("bucket", "event_id", "label", "probability", "first"))


def numbered_rows(messages: DataFrame, together: int) -> DataFrame:
    """messages(bucket, event_id, event_timestamp, embedding) with b (the bucket as text), place in the bucket by time and id, part (of so many rows) and parts."""
    rows = messages.select("bucket", "event_id", "event_timestamp", F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(F.col("bucket").cast("string"), F.lit("\0")).alias("b"))
    rows = placed(rows, "b", F.col("event_timestamp").asc_nulls_last(), F.col("event_id").asc_nulls_last()).withColumn("part", F.floor(F.col("place") / together).cast("int"))
    return rows.join(rows.groupBy("b").agg((F.max("part") + 1).alias("parts")), "b").checkpoint()


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1, 1))


def _meet(rows: DataFrame, pivots: DataFrame, schema: str, decide) -> DataFrame:
    """rows(b, part, place, embedding), pivots(b, place, embedding, rings) -> decide(rows, pivots, angles) of each part and all pivots of its bucket."""
    given = rows.select("b", "part", "place", "embedding", F.lit(False).alias("pivot"), F.lit(None).cast(RINGS).alias("rings"))
    given = given.unionByName(pivots.join(rows.select("b", "part").distinct(), "b").select("b", "part", "place", "embedding", F.lit(True).alias("pivot"), F.col("rings").cast(RINGS).alias("rings")))

    def task(group: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = group[~group["pivot"]], group[group["pivot"]].sort_values("place")
        return decide(mine, theirs, _angles(_unit(_vectors(mine)), _unit(_vectors(theirs))))

    return given.groupBy("b", "part").applyInPandas(task, schema)


def _pivots(rows: DataFrame, least: float, together: int) -> DataFrame:
    """rows(b, part, place, embedding, n) -> pivots(b, place, embedding): of each bucket one row in a quarter of ``together``, chosen by hash; then, in further rounds, some of the rows that are farther than half a link from all pivots, a larger share each time."""
    loose_at = float(np.arccos(max(min(least, 1.0), -1.0))) / 2
    every, chosen, loose = max(1, together // 4), None, rows
    for k in range(ROUNDS):
        hashed = F.pmod(F.xxhash64("b", "place", F.lit(k)), F.lit(max(1, every >> k))) == 0
        first = loose.groupBy("b").agg(F.min_by("place", F.xxhash64("b", "place")).alias("_one"))
        new = loose.join(first, "b").where(hashed | (F.col("place") == F.col("_one"))).select("b", "place", "embedding").checkpoint()
        chosen = new if chosen is None else chosen.unionByName(new)
        if k < ROUNDS - 1:
            still = lambda mine, _, angles: mine[angles.min(axis=1) > loose_at][["b", "place"]]
            left = _meet(loose, new.withColumn("rings", F.lit(None)), "b string, place long", still)
            loose = loose.join(left, ["b", "place"]).checkpoint()
    return chosen


def visits(rows: DataFrame, least: float, together: int) -> DataFrame:
    """rows(b, place, embedding) of different vectors -> b, place, embedding, cell, member: who is compared in which cell.

    A row is a member of the cell of its nearest pivot, in the ring of its angle to it. Angles
    are a metric: a row can link into a ring only if its angle to that pivot is at most a link's
    angle away from those of the ring, and exceeds that to its own pivot by at most two such
    angles. Of two rings the one that comes first visits. Every part of ``together`` rows meets
    all pivots of its bucket, a set far smaller than the bucket. Zero vectors have no angle; they
    link to nothing and stay away (where a cosine of zero or less is enough for a link,
    everything visits every ring).
    """
    prune, angle = least > 0, float(np.arccos(max(min(least, 1.0), -1.0)))
    rows = rows.where(F.exists("embedding", lambda x: x != 0)) if prune else rows
    n_parts = F.ceil(F.col("n") / together)
    dealt = rows.join(rows.groupBy("b").agg(F.count("*").alias("n")), "b").select("b", "place", "embedding", F.pmod(F.xxhash64("place", "b"), n_parts).cast("int").alias("part")).checkpoint()
    pivots = _pivots(dealt, least, together)

    def placed_in(theirs: pd.DataFrame, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest pivot, the angle and the ring."""
        at = angles.argmin(axis=1)
        own = angles[np.arange(len(at)), at]
        return at, own, (own / RING).astype(int)

    def nearest(mine: pd.DataFrame, theirs: pd.DataFrame, angles: np.ndarray) -> pd.DataFrame:
        at, own, ring = placed_in(theirs, angles)
        held = pd.DataFrame({"b": mine["b"].to_numpy(), "place": theirs["place"].to_numpy()[at], "ring": ring, "low": own, "high": own})
        return held.groupby(["b", "place", "ring"], as_index=False).agg({"low": "min", "high": "max"})

    found = _meet(dealt, pivots.withColumn("rings", F.lit(None)), "b string, place long, ring int, low double, high double", nearest)
    rings = found.groupBy("b", "place", "ring").agg(F.min("low").alias("low"), F.max("high").alias("high")).groupBy("b", "place").agg(F.collect_list(F.struct("ring", "low", "high")).alias("rings")).checkpoint()

    def allowed(mine: pd.DataFrame, theirs: pd.DataFrame, angles: np.ndarray) -> pd.DataFrame:
        at, own, ring = placed_in(theirs, angles)
        rank, slack, out = np.arange(len(theirs)), angle + 1e-6, []
        low, high = np.full((len(theirs), N_RINGS), np.inf), np.full((len(theirs), N_RINGS), -np.inf)
        for k, held in enumerate(theirs["rings"]):
            for r in held:
                low[k, r["ring"]], high[k, r["ring"]] = r["low"], r["high"]
        for r in range(N_RINGS):
            there = np.isfinite(low[:, r])[None, :]
            if not there.any():
                continue
            near = np.broadcast_to(there, angles.shape)
            if prune:
                near = there & (angles <= high[None, :, r] + slack) & (angles >= low[None, :, r] - slack) & (angles - own[:, None] <= 2 * slack)
            near = near & ((rank[None, :] > at[:, None]) | ((rank[None, :] == at[:, None]) & (r >= ring[:, None])))
            i, j = np.nonzero(near | ((rank[None, :] == at[:, None]) & (r == ring[:, None])))
            out.append(pd.DataFrame({"b": mine["b"].to_numpy()[i], "place": mine["place"].to_numpy()[i], "cell": theirs["place"].to_numpy()[j] * N_RINGS + r, "member": (at[i] == j) & (ring[i] == r)}))
        return pd.concat(out)

    met = _meet(dealt, pivots.join(rings, ["b", "place"]), "b string, place long, cell long, member boolean", allowed)
    return met.join(rows.select("b", "place", "embedding"), ["b", "place"])


def _joined(left: np.ndarray, right: np.ndarray, mine: np.ndarray, theirs: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and the roots they have -> links (root, smaller root): a forest of what pairs of left and right connect."""
    roots, code = np.unique(np.concatenate([mine, theirs]), return_inverse=True)
    i_code, j_code, low = code[: len(mine)], code[len(mine) :], np.arange(len(roots))
    for k in range(0, len(left), 512):
        i, j = np.nonzero(left[k : k + 512] @ right.T >= least)
        i, j = i_code[k + i], j_code[j]
        while True:
            x, y = low[i], low[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while (low != low[low]).any():
                low = low[low]
    moved = np.flatnonzero(low != np.arange(len(roots)))
    return roots[moved], roots[low[moved]]


def _block_links(rows: DataFrame, least: float, most: int) -> DataFrame:
    """rows(b, root, embedding, _lead) -> b, x, y: links between roots that connect what pairs with a leading row connect. Blocks of about ``most`` rows meet in pairs (``met``)."""
    parts = rows.groupBy("b", "_lead").agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
    parts = parts.join(parts.groupBy("b").agg((F.sum("_parts") > 1).alias("_many")), "b").checkpoint()
    dealt = rows.join(F.broadcast(parts), ["b", "_lead"]).withColumn("_part", F.pmod(F.xxhash64("root", "embedding"), F.col("_parts")).cast("int")).drop("_parts")

    def task(b: str, one: pd.DataFrame, other: pd.DataFrame, same: bool) -> pd.DataFrame:
        x, y = _joined(_unit(_vectors(one)), _unit(_vectors(other)), one["root"].to_numpy(), other["root"].to_numpy(), least)
        return pd.DataFrame({"b": b, "x": x, "y": y})

    return met(dealt, "b", parts.where("_many").agg(F.coalesce(F.sum("_parts"), F.lit(0))).first()[0], task, "b string, x long, y long")


def _part_links(rows: DataFrame, least: float, together: int) -> DataFrame:
    """rows(b, place, embedding) -> b, x, y: links within parts of ``together`` rows and a sample of the bucket of up to a quarter of that, which every part meets."""
    sized = rows.join(rows.groupBy("b").agg(F.count("*").alias("_n")), "b").select("b", "place", "embedding", F.ceil(F.col("_n") / together).cast("int").alias("_parts"), (F.xxhash64("place", F.lit("sample"), "b") % F.greatest(F.ceil(F.col("_n") * 4 / together), F.lit(1)) == 0).alias("_met"))
    own = F.pmod(F.xxhash64("place", "b"), F.col("_parts")).cast("int")
    each = sized.select("b", "place", "embedding", F.explode(F.when(F.col("_met"), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(own))).alias("_part"))

    def task(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        unit, place = _unit(_vectors(group)), group["place"].to_numpy()
        x, y = _joined(unit, unit, place, place, least)
        return pd.DataFrame({"b": key[0], "x": x, "y": y})

    return each.groupBy("b", "_part").applyInPandas(task, "b string, x long, y long")


def _roots(places: DataFrame, links: DataFrame) -> DataFrame:
    """places(b, place) with root, the first place of their component."""
    node = lambda c: F.struct("b", F.col(c).alias("place"))
    found = components(links.select(node("x").alias("a"), node("y").alias("b"))).select("node.*", F.col("root.place").alias("root"))
    return written(places.join(found, ["b", "place"], "left").withColumn("root", F.coalesce("root", "place")))


def connected(rows: DataFrame, least: float, together: int) -> DataFrame:
    """rows(b, place, embedding) of different vectors -> b, place, root: the first place of the component of {cosine >= least}. rows are read several times.

    Parts and a sample of the bucket are compared first. Rows of what is then the largest
    component of a bucket are connected already and needn't meet each other: all others meet all
    rows, in blocks. Where most rows link to nothing these are all pairs, in memory of a few blocks.
    """
    able = rows.where(F.exists("embedding", lambda x: x != 0)) if least > 0 else rows
    links = written(_part_links(able, least, together))
    known = _roots(able.select("b", "place"), links)
    largest = known.groupBy("b", "root").agg(F.count("*").alias("_n")).groupBy("b").agg(F.max_by("root", F.struct("_n", -F.col("root"))).alias("_largest"))
    lead = known.join(largest, "b").select("b", "place", "root", (F.col("root") != F.col("_largest")).alias("_lead"))
    more = _block_links(able.join(lead, ["b", "place"]).drop("place"), least, 4 * together)
    return _roots(rows.select("b", "place"), links.unionByName(more))


def _large_clusters(messages: DataFrame, least: float, together: int, probabilities: bool) -> DataFrame:
    """similarity_clusters for large buckets. A component is named by its first row; rows of equal vectors are compared once. Vectors are written once, all else moves without them."""
    bucket = F.coalesce(F.col("bucket").cast("string"), F.lit("\0")).alias("b")
    same = F.struct(F.xxhash64("embedding").alias("one"), F.xxhash64(F.lit("two"), "embedding").alias("two")).alias("same")
    base = messages.select("bucket", "event_id", "event_timestamp", F.col("embedding").cast("array<double>").alias("embedding"), bucket)
    base = written(base.select("*", same, F.monotonically_increasing_id().alias("_row")))
    rows = placed(base.drop("embedding"), "b", F.col("event_timestamp").asc_nulls_last(), F.col("event_id").asc_nulls_last()).withColumnRenamed("place", "own")
    copies = written(rows.groupBy("b", "same").agg(F.min("own").alias("place"), F.min_by("_row", "own").alias("_row")))
    vectors = written(base.select("_row", "embedding").join(copies.select("_row", "b", "place"), "_row").drop("_row"))
    rooted = connected(vectors, least, together).join(copies.select("b", "place", "same"), ["b", "place"]).drop("place")
    # equal zero vectors don't link, unless every pair does
    zeros = vectors.where(F.forall("embedding", lambda x: x == 0) & F.lit(least > 0)).join(copies, ["b", "place"]).select("b", "same", F.lit(True).alias("_zero"))
    rows = rows.join(rooted, ["b", "same"]).join(zeros, ["b", "same"], "left").withColumn("root", F.when(F.col("_zero"), F.col("own")).otherwise(F.col("root")))
    rows = written(rows.drop("same", "_zero"))
    counts = rows.groupBy("b", "root").agg(F.count("*").alias("n")).withColumn("label", (F.row_number().over(Window.partitionBy("b").orderBy("root")) - 1).cast("int"))
    begins = rows.groupBy("b").agg(F.min("event_timestamp").alias("first"))
    out = rows.join(counts, ["b", "root"]).join(begins, "b")
    if not probabilities:
        return out.withColumn("probability", F.lit(None).cast("double"))
    # (C05) sums of unit vectors, coordinate by coordinate; a row alone needs none
    out = out.join(base.select("_row", "embedding"), "_row")
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(size > 0, F.transform("embedding", lambda x: x / size)).otherwise(F.transform("embedding", lambda x: F.lit(0.0)))
    sums = out.where("n > 1").select("b", "root", F.posexplode(unit).alias("k", "x")).groupBy("b", "root", "k").agg(F.sum("x").alias("x"))
    centres = sums.groupBy("b", "root").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centre"))
    none = F.forall("centre", lambda x: x == 0)
    probability = F.when(F.col("n") == 1, 1.0).when(none, 0.75).otherwise(F.least(F.greatest(cosine(F.col("embedding"), F.col("centre")), F.lit(LOW)), F.lit(HIGH)))
    return out.join(centres, ["b", "root"], "left").withColumn("probability", probability)


def global_labels(local: DataFrame) -> DataFrame:
    """(C06) Labels over all buckets, in the order in which buckets begin: the sizes of earlier buckets come before. The running sum has one row for each bucket."""
    size = local.groupBy("bucket").agg(F.min("first").alias("first"), (F.max("label") + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("first", "bucket").rowsBetween(Window.unboundedPreceding, -1))
    return local.join(size.select("bucket", F.coalesce(before, F.lit(0)).alias("before")), "bucket").select("event_id", (F.col("label") + F.col("before")).alias("cluster_id"), "probability")


def run_strategy(buckets: DataFrame) -> DataFrame:
    """(C07) buckets(run_id, place, strategy) -> the strategy of each run: that of its last bucket."""
    return buckets.groupBy("run_id").agg(F.max_by("strategy", "place").alias("strategy"))


def assignment_events(assigned: DataFrame, version: str = "v1.0.0", system: str = "newsflow") -> DataFrame:
    """(C08) assigned(event_id, message_id, channel, trace_id, run_id, run_timestamp, bucket_id, cluster_id, probability) -> key, value: one topic_assignment event each."""
    topic = F.concat_ws(":", "run_id", "cluster_id")
    payload = F.struct("message_id", "channel", topic.alias("topic_id"), topic.alias("public_cluster_id"), "cluster_id", "run_id", "bucket_id", F.round("probability", 6).alias("cluster_probability"))
    event = F.struct("event_id", F.lit("topic_assignment").alias("event_type"), F.col("run_timestamp").alias("event_timestamp"), F.lit(version).alias("event_version"), F.lit(system).alias("source_system"), "trace_id", payload.alias("payload"))
    return assigned.select(F.col("event_id").alias("key"), F.to_json(event).alias("value"))


def pair_examples(messages: DataFrame, sample: int = 800, most: int = 10) -> DataFrame:
    """(C10) messages(id, entities, embedding, at) -> pairs of a sample: the most similar, the first borderline ones (cosine 0.5 to 0.6) and random ones, with their theme score.

    The sample is by hash of the id, so it doesn't depend on partitions; its pairs are at most sample squared / 2.
    """
    few = messages.withColumn("_h", F.md5(F.col("id").cast("string"))).orderBy("_h").limit(sample)
    a, b = few.alias("a"), few.alias("b")
    cos = F.round(cosine(F.col("a.embedding"), F.col("b.embedding")), 6)
    hours = F.abs(F.unix_micros(F.col("a.at").cast("timestamp")) - F.unix_micros(F.col("b.at").cast("timestamp"))) / 3.6e9
    pairs = a.join(b, F.col("a._h") < F.col("b._h")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), cos.alias("cosine"), jaccard(F.col("a.entities"), F.col("b.entities")).alias("jaccard"), hours.alias("hours"), F.md5(F.concat("a._h", "b._h")).alias("_r"))
    first = lambda df, kind, *order: df.orderBy(*order).limit(most).withColumn("kind", F.lit(kind))
    found = first(pairs, "top", F.desc("cosine"), "a", "b").unionByName(first(pairs.where("cosine between 0.5 and 0.6"), "borderline", "a", "b")).unionByName(first(pairs, "random", "_r"))
    return found.select("kind", "a", "b", "cosine", "jaccard", theme_score(F.col("cosine"), F.col("jaccard"), F.col("hours")).alias("score"))


def run_id(ids: Column, algorithm: str = "similarity") -> Column:
    """(G28) Independent of the order of the ids."""
    return F.concat(F.lit("run_"), F.substring(F.sha1(F.concat_ws("|", F.lit(algorithm), F.array_join(F.array_sort(F.collect_list(ids)), "|"))), 1, 12))


def config_score(largest: Column, noise: Column, clusters: Column) -> Column:
    """(C09) Heuristic by which a setting is chosen."""
    return F.when(largest <= 0.35, 1.0).otherwise(0.0) + F.when((noise > 0.05) & (noise < 0.9), 1.0).otherwise(0.0) + F.when(clusters > 2, 0.5).otherwise(0.0) + F.least(clusters / 20, F.lit(1.0)) - largest
