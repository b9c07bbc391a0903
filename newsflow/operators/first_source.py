"""Which message said it first (R01-R09): strict links by forward, reply and URL, else the best-scoring earlier message of the topic.

Messages have: public_cluster_id, event_id, channel, message_id, message_date, text, tokens,
entities, url_fingerprints, text_hash, simhash, and channel_id, reply_to_message_id,
forward_from_channel_id, forward_from_message_id, primary_url, any of which may be null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.functions.fingerprints import hamming, jaccard, plain_text, quotes, quotes_match
from newsflow.functions.text import snippet
from newsflow.operators.blocks import met
from newsflow.session import shared_folder, written

#: Confidences and the threshold for inferred sources.
FORWARD, REPLY, URL, EARLIEST, THRESHOLD = 1.0, 0.97, 0.92, 0.35, 0.55
#: Messages of a topic in a block; bits of the sketch of a few entities and of a text's tokens.
PART, SKETCH, WIDE = 8192, 1024, 8192


def exact_sources(m: DataFrame, everything: DataFrame) -> DataFrame:
    """(R01, J15, J17) The strict source of every message, or type unknown. Candidates come from all messages."""
    found = lambda prefix: F.struct(F.col(f"{prefix}.event_id").alias("event_id"), F.col(f"{prefix}.message_date").alias("date"))
    fwd = everything.select("channel_id", "message_id", "event_id", "message_date").dropDuplicates(["channel_id", "message_id"]).alias("f")
    rep = everything.select("channel", "message_id", "event_id", "message_date").dropDuplicates(["channel", "message_id"]).alias("r")
    j = m.alias("m").join(fwd, (F.col("m.forward_from_channel_id") == F.col("f.channel_id")) & (F.col("m.forward_from_message_id") == F.col("f.message_id")) & (F.col("f.message_date") <= F.col("m.message_date")), "left")
    j = j.join(rep, (F.col("m.channel") == F.col("r.channel")) & (F.col("m.reply_to_message_id") == F.col("r.message_id")) & (F.col("r.message_date") <= F.col("m.message_date")), "left")
    j = j.select("m.*", F.when(F.col("f.event_id").isNotNull(), found("f")).alias("forward"), F.when(F.col("r.event_id").isNotNull(), found("r")).alias("reply"))
    # the earliest publication of a link and, for itself, the second: two per link, not all pairs
    said = everything.where("primary_url is not null").select("primary_url", F.struct(F.col("message_date").alias("date"), "event_id").alias("s"))
    one = said.groupBy("primary_url").agg(F.min("s").alias("one"))
    two = said.join(one, "primary_url").where("s <> one").groupBy("primary_url").agg(F.min("s").alias("two"))
    j = j.join(one.join(two, "primary_url", "left"), "primary_url", "left")
    other = F.when(F.col("one.event_id") != F.col("event_id"), F.col("one")).otherwise(F.col("two"))
    url = F.when(other["date"] <= F.col("message_date"), F.struct(other["event_id"].alias("event_id"), other["date"].alias("date")))
    kind = F.when(F.col("forward").isNotNull(), "exact_forward").when(F.col("reply").isNotNull(), "exact_reply").when(url.isNotNull(), "exact_url").otherwise("unknown")
    sure = F.when(F.col("forward").isNotNull(), FORWARD).when(F.col("reply").isNotNull(), REPLY).when(url.isNotNull(), URL).otherwise(0.0)
    best = F.coalesce("forward", "reply", url)
    return j.select("public_cluster_id", "event_id", kind.alias("source_type"), sure.alias("confidence"), best["event_id"].alias("source_event_id"), best["date"].alias("source_date"))


def _overlap(a: Column, b: Column) -> Column:
    """Jaccard of arrays without repeats; 0 if a side is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(both > 0, both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def pair_confidence(t, c) -> Column:
    """(R02) t and c give the columns of the later and the earlier message; their arrays have no repeats."""
    d = hamming(t("simhash"), c("simhash"))
    seconds = F.greatest((F.unix_micros(t("message_date").cast("timestamp")) - F.unix_micros(c("message_date").cast("timestamp"))) / 1e6, F.lit(1.0))
    parts = [
        F.when(t("text_hash") == c("text_hash"), 0.45).otherwise(0.0), 0.35 * _overlap(t("url_fingerprints"), c("url_fingerprints")), 0.2 * _overlap(t("entities"), c("entities")), 0.2 * _overlap(t("tokens"), c("tokens")),
        F.when(d <= 3, 0.2).when(d <= 8, 0.12).when(d <= 16, 0.05).otherwise(0.0), F.least(F.lit(0.05), 0.01 + seconds / 86400 * 0.01),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.least(F.lit(0.99), total)


@F.arrow_udf(T.BinaryType())
def _sketch(places: pa.Array, width: pa.Array) -> pa.Array:
    """width bits (the same for all rows), of which those at the places are set."""
    out, bits_of = [], width[0].as_py() if len(width) else 0
    for k in range(0, len(places), 1024):
        some = places.slice(k, 1024)
        bits = np.zeros((len(some), bits_of), np.uint8)
        bits[np.repeat(np.arange(len(some)), some.value_lengths().to_numpy()), some.flatten().to_numpy()] = 1
        out += [row.tobytes() for row in np.packbits(bits, axis=1)]
    return pa.array(out, pa.binary())


def _sketched(members: str, width: int) -> Column:
    return _sketch(F.transform(members, lambda v: F.pmod(F.xxhash64(v), F.lit(width)).cast("int")), F.lit(width))


def _features(slim: DataFrame) -> DataFrame:
    """What decides which messages meet, of fixed size but for the links: fingerprint, sizes and sketches of the sets, 128 bits for all but time and id."""
    size = lambda c: F.coalesce(F.size(c), F.lit(-1))
    parts = [F.col("text_hash").isNull(), F.col("text_hash"), F.col("simhash").isNull(), F.col("simhash")]
    for c in ("tokens", "entities", "url_fingerprints"):
        parts += [size(c), F.col(c)]
    same = F.struct(*(F.xxhash64(F.lit(seed), *parts).alias(f"h{seed}") for seed in (1, 2)))
    filled = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    sets = slim.withColumns({"_tokens": filled("tokens"), "_entities": filled("entities")})
    return sets.select("public_cluster_id", "event_id", "message_date", "text_hash", "simhash", "url_fingerprints", same.alias("same"), F.size("_tokens").alias("n"), _sketched("_tokens", WIDE).alias("bits"), F.size("_entities").alias("en"), _sketched("_entities", SKETCH).alias("ebits"))


def _most_overlap(n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """No less than the Jaccard similarity of sets of n members: a bit that only one side has stands for a member that only it has."""
    out, step = np.zeros(len(i)), max(1, (1 << 19) // bits.shape[1])  # of pairs whose bits are gathered at once
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        only = lambda a, b: np.bitwise_count(bits[a] & ~bits[b]).sum(axis=1, dtype=np.int64)
        both = np.minimum(n[a] - only(a, b), n[b] - only(b, a))
        out[k : k + step] = both / (n[a] + n[b] - both)
    return out


def _near_pairs(light: DataFrame, one: DataFrame, threshold: float) -> DataFrame:
    """public_cluster_id, event_id, source: pairs that can reach the threshold without the same text or a common link.

    Entities, tokens and fingerprints give up to 0.2 each, the time 0.05. Blocks of a topic meet
    in pairs (``met``), so a task holds fingerprints and sketches of a few blocks; a pair remains
    if its score can reach the threshold by bits that differ, sizes and sketches, folded to
    SKETCH bits first. A copy of an earlier text has that text as its source and needs no other.
    """
    rest = threshold - 0.45 - 1e-9
    able = F.col("simhash").isNotNull() & (F.col("en") > 0) & (F.col("n") > 0)
    radius = 16 if rest <= 0.05 else 8 if rest <= 0.12 else 3
    at = F.unix_micros("message_date") if light.schema["message_date"].dataType.typeName() == "timestamp" else F.col("message_date")
    first = one.select("public_cluster_id", "event_id", F.lit(True).alias("first"))
    light = light.where(able).select("public_cluster_id", "event_id", "text_hash", at.alias("at"), "simhash", "n", "bits", "en", "ebits")
    light = light.join(first, ["public_cluster_id", "event_id"], "left").where("first or text_hash is null").drop("text_hash").withColumn("first", F.coalesce("first", F.lit(False)))
    shared_folder(light.sparkSession)
    light = written(light)
    parts = light.groupBy("public_cluster_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).checkpoint()
    dealt = light.join(parts, "public_cluster_id").withColumns({"_part": F.pmod(F.xxhash64("event_id"), F.col("parts")).cast("int"), "_lead": F.lit(True), "_many": F.col("parts") > 1}).drop("parts")
    points = np.where(np.arange(65) <= 3, 0.2, np.where(np.arange(65) <= 8, 0.12, np.where(np.arange(65) <= 16, 0.05, 0.0)))

    def task(topic, mine: pd.DataFrame, theirs: pd.DataFrame, same: bool) -> pd.DataFrame:
        group = mine.assign(part=0) if same else pd.concat([mine.assign(part=0), theirs.assign(part=1)])
        group = group.sort_values(["at", "event_id"], na_position="first", kind="stable")
        words = lambda c: np.frombuffer(b"".join(group[c]), np.uint64).reshape(len(group), -1)
        prints, bits, ebits = group["simhash"].to_numpy(np.int64).view(np.uint64), words("bits"), words("ebits")
        few = np.bitwise_or.reduce(bits.reshape(len(group), WIDE // SKETCH, -1), axis=1)
        n, en, part, source = (group[c].to_numpy() for c in ("n", "en", "part", "first"))
        later, former = [], []
        for k in range(0, len(group), 256):
            differ = np.bitwise_count(prints[k : k + 256, None] ^ prints[None, : k + 256])
            i, j = np.nonzero(differ <= radius)
            i = i + k
            fit = (j < i) & source[j] & (same | (part[i] != part[j]))
            i, j = i[fit], j[fit]
            need = threshold - 0.05 - points[differ[i - k, j]] - 1e-9  # of entities and tokens
            fit = 0.2 * np.minimum(n[i], n[j]) / np.maximum(n[i], n[j]) >= need - 0.2
            i, j, need = i[fit], j[fit], need[fit]
            need = need - 0.2 * _most_overlap(en, ebits, i, j)
            i, j, need = i[need <= 0.2], j[need <= 0.2], need[need <= 0.2]
            for sketch in (few, bits):
                fit = 0.2 * _most_overlap(n, sketch, i, j) >= need
                i, j, need = i[fit], j[fit], need[fit]
            later.append(i)
            former.append(j)
        ids = group["event_id"].to_numpy()
        return pd.DataFrame({"public_cluster_id": topic, "event_id": ids[np.concatenate(later)], "source": ids[np.concatenate(former)]})

    kinds = {c: light.schema[c].dataType.simpleString() for c in ("public_cluster_id", "event_id")}
    return met(dealt, "public_cluster_id", parts.where("parts > 1").agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0], task, f"public_cluster_id {kinds['public_cluster_id']}, event_id {kinds['event_id']}, source {kinds['event_id']}")


def _candidates(slim: DataFrame, threshold: float) -> DataFrame:
    """slim -> public_cluster_id, event_id, source: the pairs that can reach the threshold (all if it is 0.45 or less).

    Of messages that differ in time and id only, the earliest scores best: it alone is a
    candidate, so copies cost one candidate for each later message instead of all pairs.
    """
    near = 0.45 < threshold <= 0.65 + 1e-9  # beyond it nothing is reached without the same text or a common link
    light = _features(slim)
    light = light if threshold <= 0.45 else written(light if near else light.drop("n", "bits", "en", "ebits"))
    one = light.groupBy("public_cluster_id", F.col("message_date").isNull(), "same").agg(F.min(F.struct("message_date", "event_id")).alias("m")).select("public_cluster_id", "m.*")
    earlier = F.struct("c.message_date", "c.event_id") < F.struct("t.message_date", "t.event_id")
    pair = [F.col("t.public_cluster_id").alias("public_cluster_id"), F.col("t.event_id").alias("event_id"), F.col("c.event_id").alias("source")]
    if threshold <= 0.45:
        return light.alias("t").join(one.alias("c"), (F.col("t.public_cluster_id") == F.col("c.public_cluster_id")) & earlier).select(*pair).distinct()
    text = F.when(F.col("text_hash").isNotNull(), F.array(F.xxhash64(F.lit("text"), "text_hash"))).otherwise(F.array().cast("array<long>"))
    links = F.transform(F.coalesce("url_fingerprints", F.array().cast("array<string>")), lambda u: F.xxhash64(F.lit("link"), u))
    keyed = light.select("public_cluster_id", "event_id", "message_date", F.explode(F.array_distinct(F.concat(text, links))).alias("key"))
    known = keyed.join(one.select("public_cluster_id", "event_id"), ["public_cluster_id", "event_id"], "left_semi")
    meet = (F.col("t.public_cluster_id") == F.col("c.public_cluster_id")) & (F.col("t.key") == F.col("c.key")) & earlier
    found = keyed.alias("t").join(known.alias("c"), meet).select(*pair)
    if near:
        found = found.unionByName(_near_pairs(light, one, threshold))
    return found.distinct()


def inferred_sources(m: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(R02-R04, J16) For every message the best earlier one of its topic; below the threshold the earliest.

    Only pairs that can reach the threshold are scored (``_candidates``), by exact bounds of the
    parts of the score, so the result is that of scoring all earlier messages. Different texts
    that share one link are still compared with each other. m is read several times: persist it
    if it is dear.
    """
    # what a pair needs is prepared once per message: sets without blanks
    members = lambda c: F.array_distinct(F.filter(c, lambda v: v != "")).alias(c)
    sets = [members(c) for c in ("tokens", "entities", "url_fingerprints")]
    found = written(_candidates(m.select("public_cluster_id", "event_id", "message_date", "text_hash", "simhash", *sets), threshold))
    # sets and texts are read once, for messages of some pair
    ends = found.select("public_cluster_id", F.explode(F.array("event_id", "source")).alias("event_id")).distinct()
    known = written(m.join(ends, ["public_cluster_id", "event_id"], "left_semi").select("public_cluster_id", "event_id", "message_date", "text_hash", "simhash", *sets, "text"))
    pairs = found.join(known.alias("t"), ["public_cluster_id", "event_id"]).join(known.withColumnRenamed("event_id", "source").alias("c"), ["public_cluster_id", "source"])
    of = lambda prefix: lambda name: F.col(f"{prefix}.{name}")
    scored = pairs.select("public_cluster_id", "event_id", "source", F.col("c.message_date").alias("date"), pair_confidence(of("t"), of("c")).alias("confidence"))
    best = scored.groupBy("public_cluster_id", "event_id").agg(F.min(F.struct((-F.col("confidence")).alias("minus"), "date", "source")).alias("best")).where(-F.col("best.minus") >= threshold)
    best = written(best)
    # texts are compared for the best pair only, where the later one has quotes
    said = known.select("public_cluster_id", "event_id", quotes(F.col("text")).alias("quotes")).where(F.size("quotes") > 0)
    plain = known.select("public_cluster_id", F.col("event_id").alias("source"), plain_text(F.col("text")).alias("plain"))
    held = best.select("public_cluster_id", "event_id", F.col("best.source").alias("source")).join(said, ["public_cluster_id", "event_id"]).join(plain, ["public_cluster_id", "source"])
    held = held.groupBy("public_cluster_id", "event_id").agg(F.bool_and(F.exists("quotes", lambda q: F.col("plain").contains(q))).alias("quoted"))
    best = best.join(held, ["public_cluster_id", "event_id"], "left")
    first = m.groupBy("public_cluster_id").agg(F.min(F.struct(F.col("message_date").alias("date"), F.col("event_id").alias("source"))).alias("first"))
    out = m.select("public_cluster_id", "event_id", "message_date").join(best, ["public_cluster_id", "event_id"], "left").join(first, "public_cluster_id", "left")
    has = F.coalesce(F.col("first") < F.struct("message_date", "event_id"), F.lit(False))
    good = F.coalesce(-F.col("best.minus") >= threshold, F.lit(False))
    kind = F.when(~has, "unknown").when(~good, "earliest_in_cluster").when(F.col("quoted"), "quoted").otherwise("inferred_semantic")
    known = lambda name: F.when(good, F.col(f"best.{name}")).when(has, F.col(f"first.{name}"))
    sure = F.when(~has, 0.0).when(good, -F.col("best.minus")).otherwise(EARLIEST)
    return out.select("public_cluster_id", "event_id", kind.alias("source_type"), sure.alias("confidence"), known("source").alias("source_event_id"), known("date").alias("source_date"))


def cluster_exact(exact: DataFrame) -> DataFrame:
    """(R05) The earliest strict source of a topic, of several the surest."""
    known = F.when(F.col("source_type") != "unknown", F.struct("source_date", (-F.col("confidence")).alias("minus"), "source_event_id", "source_type"))
    b = exact.groupBy("public_cluster_id").agg(F.min(known).alias("b"))
    return b.select("public_cluster_id", F.coalesce("b.source_type", F.lit("unknown")).alias("source_type"), F.coalesce(-F.col("b.minus"), F.lit(0.0)).alias("confidence"), "b.source_event_id")


def cluster_inferred(m: DataFrame) -> DataFrame:
    """(R06) The earliest message of a topic."""
    return m.groupBy("public_cluster_id").agg(F.min_by("event_id", F.struct("message_date", "event_id")).alias("source_event_id")).withColumn("confidence", F.lit(EARLIEST))


def propagation_links(exact: DataFrame, inferred: DataFrame) -> DataFrame:
    """(R07) One parent per message: the strict source, else the inferred one, never itself."""
    e, i = exact.alias("e"), inferred.alias("i")
    use = lambda p: F.col(f"{p}.source_event_id").isNotNull() & (F.col(f"{p}.source_event_id") != F.col(f"{p}.event_id"))
    j = e.join(i, ["public_cluster_id", "event_id"])
    pick = lambda c: F.when(use("e"), F.col(f"e.{c}")).when(use("i"), F.col(f"i.{c}"))
    out = j.select("public_cluster_id", F.col("event_id").alias("child"), pick("source_event_id").alias("parent"), pick("source_type").alias("link_type"), pick("confidence").alias("confidence"))
    return out.where("parent is not null")


def pending(assigned: DataFrame, resolutions: DataFrame, most: int = 20) -> DataFrame:
    """(R09, J08) Topics that lack the exact or the inferred resolution."""
    have = resolutions.groupBy("public_cluster_id").agg(F.countDistinct("resolution_kind").alias("kinds"))
    return assigned.where("cluster_id >= 0").select("public_cluster_id").distinct().join(have.where("kinds >= 2"), "public_cluster_id", "left_anti").orderBy("public_cluster_id").limit(most)


def evidence(t, c) -> Column:
    """(R08)"""
    four = lambda x: x.cast("decimal(10,4)").cast("double")
    return F.struct(
        (t("text_hash") == c("text_hash")).alias("same_text"), four(jaccard(t("url_fingerprints"), c("url_fingerprints"))).alias("url_overlap"), four(jaccard(t("entities"), c("entities"))).alias("entity_overlap"),
        four(jaccard(t("tokens"), c("tokens"))).alias("lexical_similarity"), hamming(t("simhash"), c("simhash")).alias("distance"), quotes_match(t("text"), c("text")).alias("quoted"), snippet(c("text")).alias("snippet"),
    )
