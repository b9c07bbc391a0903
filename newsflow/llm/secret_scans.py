"""Operator 7: secret scans by multipart credential linking.

Strong parts (assignments with a long value, access identifiers, long hex runs) are reported
as they are. Weak parts (short assigned values, account names, mixed random-looking tokens,
service addresses) are reported only when a complementary part - identifier, secret or
endpoint - stands within ``reach`` characters. That is an interval join: parts are dealt to
bins of ``reach`` characters and joined on document and bin, so no document compares all its
parts with each other, and one with very many parts spreads over many keys.

Only built-in functions. Defined results: null text counts as empty; null and repeated
doc_ids give one row each; two rows with the same doc_id and text get the same spans; other
columns are not read. Places are code points, ends exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.shared import shared_folder

#: name: (pattern, group whose length counts, least length, most length, role, strong)
VALUE = r"[A-Za-z0-9+/_.=-]+"
_ASSIGN = rf"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?({VALUE})"
_ACCOUNT = rf"(?i:access_key_id|client_id|account_id|account|username|login)[\"']?\x20*[:=]\x20*[\"']?({VALUE})"
_MIXED = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/_.=-])"
_ENDPOINT = r"(?:https?|ftp|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9.:@/_-]+"
KINDS = ("assign", "access", "hex", "account", "token", "value", "endpoint")
#: Arrays are built in parts of so many elements, since appending copies them.
PART = 64


def gathered(items: Column, state: Column, step, kind: str) -> Column:
    """The array that step(state, item) -> (new state, element or null) makes of items, without copying all of it for each element."""
    none, parts = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def add(acc: Column, item: Column) -> Column:
        after, element = step(acc["state"], item)
        full = F.size(acc["part"]) >= PART
        part = F.when(full, none).otherwise(acc["part"])
        return F.struct(after.alias("state"), F.when(full, F.concat(acc["parts"], F.array(acc["part"]))).otherwise(acc["parts"]).alias("parts"), F.when(element.isNull(), part).otherwise(F.concat(part, F.array(element))).alias("part"))

    return F.aggregate(items, F.struct(state.alias("state"), parts.alias("parts"), none.alias("part")), add, lambda acc: F.flatten(F.concat(acc["parts"], F.array(acc["part"]))))


def _found(text: Column, kind: str, pattern: str, likely: Column, role: str, keep=lambda m: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches as structs (start, rank, end, role); split() gives what stands between them."""
    matches = F.expr("regexp_extract_all(_text, _pattern, 0)".replace("_text", "_t").replace("_pattern", _literal(pattern)))
    gaps = F.split(text, pattern, -1)
    rank = KINDS.index(kind)
    row = "struct<start:int,rank:int,end:int,role:string,text:string>"

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        start, end = at + F.length(m["g"]), at + F.length(m["g"]) + F.length(m["m"])
        return end, F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(role).alias("role"), m["m"].alias("text"))

    pairs = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    spans = gathered(pairs, F.lit(0), step, row)
    return F.when(likely, F.filter(spans, lambda s: keep(s["text"]))).otherwise(F.array().cast(f"array<{row}>"))


def _literal(pattern: str) -> str:
    """A regular expression as an SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _value_length(match: Column, pattern: str, group: int) -> Column:
    return F.length(F.regexp_extract(match, pattern, group))


def parts(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, key, strong and weak parts, each sorted by start and kind."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).withColumn("_low", F.lower("_t"))
    t, low = F.col("_t"), F.col("_low")
    named = _any(low, ("pass", "secret", "token", "api"))
    d = d.select(
        "doc_id",
        F.xxhash64("_t").alias("key"),
        _found(t, "assign", _ASSIGN, named & t.rlike(_ASSIGN), "secret").alias("_assign"),
        _found(t, "access", "AKIA[A-Z0-9]+", t.contains("AKIA"), "id", lambda m: F.length(m) >= 18).alias("_access"),
        _found(t, "hex", "[0-9a-f]{16,}", t.rlike("[0-9a-f]{16}"), "secret").alias("_hex"),
        _found(t, "account", _ACCOUNT, _any(low, ("_id", "account", "username", "login")) & t.rlike(_ACCOUNT), "id").alias("_account"),
        _found(t, "token", _MIXED, t.rlike("[A-Za-z0-9+/]{20}") & t.rlike(_MIXED), "secret").alias("_token"),
        _found(t, "endpoint", _ENDPOINT, t.contains("://"), "endpoint").alias("_endpoint"),
    )
    long_value = lambda s: _value_length(s["text"], _ASSIGN, 2) >= 12
    weak_value = lambda s: (_value_length(s["text"], _ASSIGN, 2) >= 6) & ~long_value(s)
    as_value = F.transform(F.filter("_assign", weak_value), lambda s: s.withField("rank", F.lit(KINDS.index("value"))))
    bare = lambda a: F.transform(a, lambda s: s.dropFields("text"))
    return d.select(
        "doc_id",
        "key",
        F.sort_array(bare(F.concat(F.filter("_assign", long_value), "_access", "_hex"))).alias("strong"),
        F.sort_array(bare(F.concat("_account", "_token", as_value, "_endpoint"))).alias("weak"),
    )


def linked(found: DataFrame, reach: int = 160) -> DataFrame:
    """parts() with spans: strong ones and the weak ones that have a complementary part within reach."""
    keyed = found.withColumn("_doc", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    open_ = (F.size("weak") > 0) & (F.size("weak") + F.size("strong") > 1)
    some = keyed.where(open_).select("_doc", "key", "weak", "strong").distinct()
    bins = lambda s, by: F.sequence(F.floor((s["start"] - by) / reach).cast("int"), F.floor((s["end"] + by) / reach).cast("int"))
    weak = some.select("_doc", "key", F.explode("weak").alias("w")).withColumn("bin", F.explode(bins(F.col("w"), 0)))
    near = some.select("_doc", "key", F.explode(F.concat("weak", "strong")).alias("p")).withColumn("bin", F.explode(bins(F.col("p"), reach)))
    gap = F.greatest(F.col("w.start") - F.col("p.end"), F.col("p.start") - F.col("w.end"))
    held = weak.join(near, ["_doc", "key", "bin"]).where((gap <= reach) & (F.col("w.role") != F.col("p.role"))).groupBy("_doc", "key", "w").agg(F.lit(1).alias("one"))
    held = held.groupBy("_doc", "key").agg(F.collect_list("w").alias("held"))
    rest = keyed.where(~open_).withColumn("spans", F.col("strong"))
    joined = keyed.where(open_).join(held, ["_doc", "key"], "left").withColumn("spans", F.sort_array(F.concat("strong", F.coalesce("held", F.array().cast(found.schema["weak"].dataType)))))
    return rest.select("doc_id", "key", "strong", "spans").unionByName(joined.select("doc_id", "key", "strong", "spans"))


def scan(docs: DataFrame, reach: int = 160) -> DataFrame:
    """docs -> doc_id, key (hash of the text), strong, spans: arrays of (start, rank, end, role); rank indexes KINDS."""
    shared_folder(docs.sparkSession)
    return linked(parts(docs).checkpoint(), reach)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["rank"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def redact(docs: DataFrame, reach: int = 160) -> DataFrame:
    """docs with every reported span replaced by its kind in square brackets; of overlapping ones the first."""
    found = scan(docs, reach).where(F.size("spans") > 0)
    apart = lambda at, s: (F.greatest(at, s["end"]), F.when(s["start"] >= at, F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"))))
    spans = gathered(F.col("spans"), F.lit(0), apart, "struct<start:int,end:int,rank:int>")
    names = ["__newsflow_null", "__newsflow_id", "__newsflow_key"]
    found = found.select(F.col("doc_id").isNull().alias(names[0]), F.coalesce("doc_id", F.lit(0)).alias(names[1]), F.col("key").alias(names[2]), spans.alias("__newsflow_spans")).distinct()
    keyed = docs.withColumns(dict(zip(names, (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64(F.coalesce("text", F.lit("")))), strict=True)))
    joined = keyed.join(found, names, "left")
    all_ = F.col("__newsflow_spans")
    end_of = lambda k: F.coalesce(F.get(all_, k)["end"], F.lit(0))
    name = lambda s: F.concat(F.lit("["), F.get(F.array(*map(F.lit, KINDS)), s["rank"]), F.lit("]"))

    def part(k: Column) -> Column:
        """The spans from k on with what stands before each, cut from the text of this part only: places are found by counting characters."""
        base = F.when(k == 0, F.lit(0)).otherwise(end_of(F.greatest(k - 1, F.lit(0))))
        upto = end_of(F.least(k + PART, F.size(all_)) - 1)
        pieces = lambda text: F.transform(F.slice(all_, k + 1, F.lit(PART)), lambda s, i: F.concat(_between(text, F.when(i == 0, base).otherwise(end_of(F.greatest(k + i - 1, F.lit(0)))) - base, s["start"] - base), name(s)))
        return F.get(F.transform(F.array(_between(F.col("text"), base, upto)), lambda text: F.array_join(pieces(text), "")), F.lit(0))

    heads = F.sequence(F.lit(0), F.size(all_) - 1, F.lit(PART))
    clean = F.concat(F.array_join(F.transform(heads, part), ""), _between(F.col("text"), end_of(F.size(all_) - 1), F.length("text")))
    return joined.withColumn("text", F.when(F.size(all_) > 0, clean).otherwise(F.col("text"))).select(*docs.columns)


def _between(text: Column, start: Column, end: Column) -> Column:
    return text.substr(start + 1, F.greatest(end - start, F.lit(0)))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("strong", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(F.col("strong")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
