"""Scorers and what follows them (M01-M15): labels and thresholds, entities, relations, aliases, cluster terms.

Models are plugged in as functions over batches of texts; the defaults are small, fixed and
deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions.fingerprints import label_of, softmax
from newsflow.functions.text import WORD, blank, surface

#: Labels in the order of the logits.
LABELS = ("negative", "neutral", "positive")
GOOD = "good great growth gain win success profit рост успех прибыль победа хорошо"
BAD = "bad loss crash fall fail crisis war падение кризис убыток война плохо"


def lexicon_logits(text: Column) -> Column:
    """The default scorer: twice the counts of good and bad words, a bias for neutral."""
    words = F.split(F.lower(text), f"[^{WORD}]+")
    n = lambda known: F.size(F.filter(words, lambda w: w.isin(*known.split()))).cast("double") * 2
    return F.array(n(BAD), F.lit(1.0), n(GOOD))


def sentiment(df: DataFrame, text: str = "text") -> DataFrame:
    """(M01, M02, X30) label and score; blank texts are neutral with 1."""
    # columns of their own, or the text would be split again for every use of a logit
    split = df.withColumn("_words", F.split(F.lower(text), f"[^{WORD}]+"))
    split = split.withColumn("_logits", word_logits(F.col("_words"))).withColumn("_p", softmax(F.col("_logits")))
    out = split.withColumn("probabilities", F.when(blank(F.col(text)), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).otherwise(F.col("_p")))
    return out.withColumns({"label": label_of(F.col("probabilities"), LABELS), "score": F.array_max("probabilities")}).drop("_words", "_logits", "_p")


def score_with(df: DataFrame, scorer: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """(M01, M04, M05, M13) A plugged-in model: it is loaded once per task and sees batches of texts."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, scores array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.assign(scores=scorer(part[text].fillna("").tolist()))

    return df.mapInPandas(run, schema)


def hashed_embeddings(df: DataFrame, text: str = "text", most_words: int = 2) -> DataFrame:
    """(M13) The default embedder: df with embedding, 64 numbers of length one; blank texts have zeros.

    Runs of one to ``most_words`` words are hashed to 64 bits by built-in functions; each bit
    adds one to its coordinate or takes one off. That is a fixed random projection of the counts
    of runs, so texts that share most of their words have a high cosine. A column named
    embedding is replaced.
    """
    df = df.drop("embedding")
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), f"[^{WORD}]+"), lambda w: w != "")
    split = df.withColumn("_words", words)
    runs = [F.transform("_words", lambda w: F.xxhash64(w))]
    for n in range(2, most_words + 1):
        runs.append(_run_hashes(n))
    hashed = split.withColumn("_hashes", F.concat(*runs)).drop("_words")
    kept = df.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, embedding array<double>"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for hashes in batch.column(len(kept)):
                h = hashes.values.to_numpy() if hashes.is_valid else np.empty(0, np.int64)
                total = np.zeros(64)
                for k in range(0, len(h), 4096):
                    total += 2.0 * np.unpackbits(h[k : k + 4096].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0) - len(h[k : k + 4096])
                size = np.linalg.norm(total)
                rows.append((total / size if size else total).tolist())
            yield pa.record_batch([*batch.columns[: len(kept)], pa.array(rows, pa.list_(pa.float64()))], names=[*kept, "embedding"])

    return hashed.select(*kept, "_hashes").mapInArrow(project, schema)


def _run_hashes(n: int) -> Column:
    """Hashes of the runs of n words of the column _words."""
    begins = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_words") - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.size("_words"))
    return F.transform(begins, lambda i: F.xxhash64(F.array_join(F.slice("_words", i, F.lit(n)), " ")))


def chunks(ids: Column, size: int = 384, overlap: int = 64) -> Column:
    """(M06) Windows over token ids; the last one ends at the end."""
    n, step = F.size(ids), size - overlap
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(ids, k * step + 1, F.lit(size)))


def windows(n_tokens: int, size: int = 384, overlap: int = 64, specials: int = 2) -> list[tuple[int, int]]:
    """Begin and end of the chunks of so many tokens; ``specials`` of the size are for the model's own tokens."""
    size = max(1, size - specials)
    step = max(1, size - min(overlap, size - 1))
    last = max(0, -(-(n_tokens - size) // step))
    return [(k * step, min(n_tokens, k * step + size)) for k in range(last + 1)] if n_tokens else []


def word_logits(words: Column, good: Sequence[str] = tuple(GOOD.split()), bad: Sequence[str] = tuple(BAD.split())) -> Column:
    """lexicon_logits of words."""
    n = lambda known: F.size(F.filter(words, lambda w: w.isin(*known))).cast("double") * 2
    return F.array(n(bad), F.lit(1.0), n(good))


def _judged(df: DataFrame, text: str, n_tokens: Column, logits: Column) -> DataFrame:
    """probabilities, label and score from mean logits; no tokens have logits of zero, blank texts are neutral with 1."""
    known = F.when(n_tokens > 0, logits).otherwise(F.array(*[F.lit(0.0)] * len(LABELS)))
    out = df.withColumn("probabilities", F.when(blank(F.col(text)), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).otherwise(softmax(known)))
    return out.withColumns({"label": label_of(F.col("probabilities"), LABELS), "score": F.array_max("probabilities")})


def chunked_sentiment(df: DataFrame, text: str = "text", size: int = 384, overlap: int = 64, specials: int = 2, logits: Callable[[Column], Column] = word_logits) -> DataFrame:
    """(M01) df with chunks (their number), probabilities, label and score: a text's words go in overlapping chunks, each is scored by itself and the mean of the logits decides.

    logits(words of a chunk) is a column of three numbers; everything stays in its row, without
    a shuffle. score_chunks does the same with a plugged-in tokenizer and model.
    """
    size = max(1, size - specials)
    split = df.withColumn("_words", F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), f"[^{WORD}]+"), lambda w: w != ""))
    each = split.withColumn("_logits", F.transform(chunks(F.col("_words"), size, min(overlap, size - 1)), lambda w: logits(w)))
    total = F.aggregate("_logits", F.array(*[F.lit(0.0)] * len(LABELS)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    mean = F.transform(total, lambda x: x / F.size("_logits"))
    out = _judged(each.withColumn("chunks", F.when(F.size("_words") > 0, F.size("_logits")).otherwise(0)), text, F.size("_words"), mean)
    return out.drop("_words", "_logits")


def score_chunks(df: DataFrame, tokenize: Callable[[list[str]], list[list[int]]], scorer: Callable[[list[list[int]]], list[list[float]]], text: str = "text", size: int = 384, overlap: int = 64, specials: int = 2, batch: int = 64) -> DataFrame:
    """(M01) chunked_sentiment with a model: tokenize gives token ids of texts, scorer logits of chunks of ids, up to ``batch`` chunks at once."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, chunks int, _logits array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            ids = tokenize(part[text].fillna("").tolist())
            own = [[x[a:b] for a, b in windows(len(x), size, overlap, specials)] for x in ids]
            flat = [c for cs in own for c in cs]
            scores = [row for k in range(0, len(flat), batch) for row in scorer(flat[k : k + batch])]
            ends = np.cumsum([len(cs) for cs in own]).tolist()
            means = [np.mean(scores[b - len(cs) : b], axis=0).tolist() if cs else None for cs, b in zip(own, ends, strict=True)]
            yield part.assign(chunks=[len(cs) for cs in own], _logits=means)

    out = df.mapInPandas(run, schema)
    return _judged(out, text, F.col("chunks"), F.col("_logits")).drop("_logits")


def tfidf_terms(docs: DataFrame, most: int = 10, stop: Sequence[str] = (), features: int = 5000) -> DataFrame:
    """(M15) docs(cluster, text) -> cluster, term, score, place: one or two words, counts times the smoothed inverse cluster frequency, unit length by cluster.

    The ``features`` most frequent terms of all clusters count, of equal ones the first by
    alphabet; words of the stop list are gone before pairs are made; pairs lie within a text.
    """
    words = F.filter(F.split(F.lower("text"), f"[^{WORD}]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*(stop or ("",))))
    split = docs.where("cluster is not null").select("cluster", words.alias("_w"))  # a column of its own, see cluster_terms
    two = F.zip_with(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    counts = split.select("cluster", F.explode(F.concat("_w", two)).alias("term")).groupBy("cluster", "term").agg(F.count("*").alias("tf"))
    kept = counts.groupBy("term").agg(F.sum("tf").alias("all"), F.count("*").alias("df")).orderBy(F.desc("all"), "term").limit(features)
    n = split.select("cluster").distinct().agg(F.count("*").alias("n"))  # one row
    weighed = counts.join(F.broadcast(kept), "term").join(n).withColumn("weight", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norms = weighed.groupBy("cluster").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    scored = weighed.join(norms, "cluster").select("cluster", "term", F.round(F.col("weight") / F.col("norm"), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "term"))
    return scored.withColumn("place", place).where(F.col("place") <= most)


def normalized_label(label: Column) -> Column:
    """(M03)"""
    low = F.lower(label)
    return F.when(low.isin("label_0", "neg", "negative"), "negative").when(low.isin("label_2", "pos", "positive"), "positive").otherwise("neutral")


def language_gate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(M07) What is analysed in full, and what is only marked as done."""
    full = (F.col("analysis_mode") == "full") & F.col("language").isin("ru", "en")
    return df.where(full), df.where(~F.coalesce(full, F.lit(False)))


def entities(df: DataFrame, keep: tuple[str, ...] = ("event_id",), text: str = "text", least: int = 3) -> DataFrame:
    """(M08, M09) Runs of capitalised words that don't begin a sentence, each mention with its place; numbers and short ones are left out."""
    # nothing follows the repeated group, so it may be possessive: else each further word of a run takes a frame of the stack, which a run of thousands overflows
    pattern = r"(?<=[\p{Ll}\p{N},;] )(\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)*+)"
    matches, gaps = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), F.split(text, pattern, -1)
    pairs = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    span = lambda acc, x: F.struct((acc["at"] + F.length(x["g"])).alias("start_pos"), x["m"].alias("entity_text"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(span(acc, x))).alias("out"))
    none = F.array().cast("array<struct<start_pos:int,entity_text:string>>")
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    e = df.select(*keep, F.explode_outer(spans).alias("_s")).select(*keep, "_s.start_pos", "_s.entity_text").where(F.length("entity_text") >= least)
    end = F.col("start_pos") + F.length("entity_text")
    return e.select(*keep, "entity_text", F.lower(surface(F.col("entity_text"))).alias("normalized_text"), F.lit("MISC").alias("entity_type"), "start_pos", end.alias("end_pos"), F.lit(0.8).alias("confidence"))


def relations(spans: DataFrame, key: str = "event_id") -> DataFrame:
    """(M10, U04) Unordered pairs of different entities of a message once each, the first orientation kept.

    Spans of an entity are reduced to its first place before pairs are made.
    """
    name = F.lower(F.coalesce("normalized_text", "entity_text"))
    firsts = spans.withColumn("k", name).groupBy(key, "k").agg(F.min("start_pos").alias("at"))
    a, b = firsts.alias("a"), firsts.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.struct("a.at", "a.k") < F.struct("b.at", "b.k")))
    return pairs.select(F.col(f"a.{key}").alias(key), F.col("a.k").alias("subject"), F.lit("CO_OCCURS_WITH").alias("predicate"), F.col("b.k").alias("object"), F.lit(1.0).alias("confidence"))


def full_names(people: DataFrame) -> DataFrame:
    """(M11) people(name) -> surname, name: for a single-word name the most frequent longer one that ends with it, of several the longest."""
    n = people.groupBy("name").agg(F.count("*").alias("n")).withColumn("surname", F.element_at(F.split("name", " "), -1))
    long = n.where("instr(name, ' ') > 0").groupBy("surname").agg(F.max_by("name", F.struct("n", F.length("name"), "name")).alias("name"))
    return n.where("instr(name, ' ') = 0").select("surname").join(long, "surname")


def display_names(mentions: DataFrame) -> DataFrame:
    """(M12) mentions(entity_key, entity_text) -> the text shown for a key and its number of aliases: most frequent, then longest."""
    n = mentions.groupBy("entity_key", "entity_text").agg(F.count("*").alias("n"))
    return n.groupBy("entity_key").agg(F.max_by("entity_text", F.struct("n", F.length("entity_text"), "entity_text")).alias("shown"), F.count("*").alias("aliases"))


def cluster_terms(docs: DataFrame, most: int = 10, stop: tuple[str, ...] = ()) -> DataFrame:
    """(M15) docs(cluster, text) -> cluster, term, score: term counts of a cluster times ln(1 + mean cluster size / corpus count)."""
    words = F.filter(F.split(F.lower("text"), f"[^{WORD}]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*(stop or ("",))))
    split = docs.select("cluster", words.alias("_w"))  # a column of its own, or every step of the lambda would split the text again
    two = F.filter(F.transform("_w", lambda w, i: F.concat_ws(" ", w, F.get("_w", i + 1))), lambda x: x.contains(" "))
    terms = split.select("cluster", F.explode_outer(F.concat("_w", two)).alias("term")).where("term is not null").groupBy("cluster", "term").agg(F.count("*").alias("tf"))
    # a term has one row for each cluster: summed where its rows lie, instead of joined to its sum
    whole = terms.withColumn("all", F.sum("tf").over(Window.partitionBy("term")))
    mean = terms.agg((F.sum("tf") / F.countDistinct("cluster")).alias("mean"))  # one row
    scored = whole.join(mean).select("cluster", "term", (F.col("tf") * F.log(1 + F.col("mean") / F.col("all"))).alias("score"))
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), "term")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def mean_probabilities(*backends: Column) -> Column:
    """(M04) The mean of several backends' probabilities, label by label."""
    total = backends[0]
    for p in backends[1:]:
        total = F.zip_with(total, p, lambda x, y: x + y)
    return F.transform(total, lambda x: x / len(backends))


def emotions(labels: Column, scores: Column, names: dict[str, str]) -> Column:
    """(M05) map of emotion to score: labels renamed, unknown ones left out, the greatest score of those that meet, four digits."""
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    pairs = F.filter(F.zip_with(labels, scores, lambda n, x: F.struct(F.try_element_at(known, F.lower(n)).alias("n"), x.alias("x"))), lambda p: p["n"].isNotNull())
    best = lambda n: F.array_max(F.transform(F.filter(pairs, lambda p: p["n"] == n), lambda p: p["x"]))
    return F.transform_values(F.map_from_arrays(F.array(*(F.lit(n) for n in sorted(set(names.values())))), F.array(*(best(n) for n in sorted(set(names.values()))))), lambda _, x: F.round(x, 4))


def classification_report(df: DataFrame) -> DataFrame:
    """(M14) df(actual, predicted) -> accuracy and macro F1, one row."""
    n = df.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    ends = n.select(F.col("actual").alias("label"), "n", F.lit(0).alias("p"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")).unionByName(n.select(F.col("predicted").alias("label"), F.lit(0).alias("n"), F.col("n").alias("p"), F.lit(0).alias("hit")))
    per = ends.groupBy("label").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    f1 = F.when(F.col("hit") == 0, 0.0).otherwise(2 * F.col("hit") / (F.col("n") + F.col("p")))
    return per.agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def train_topics(docs: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14, held: int = 10):
    """(M14) docs(id, text, label) -> a fitted text classifier and its predictions (actual, predicted) on the tenth of ids that a hash holds out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IndexToString, RegexTokenizer, StringIndexer

    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(docs)
    stages = [RegexTokenizer(inputCol=text, outputCol="_w", pattern=f"[^{WORD}]+"), HashingTF(inputCol="_w", outputCol="_x", numFeatures=features), index, LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", maxIter=20, regParam=0.01), IndexToString(inputCol="_p", outputCol="predicted", labels=index.labels)]
    out = F.pmod(F.xxhash64("id"), F.lit(held)) == 0
    model = Pipeline(stages=stages).fit(docs.where(~out))
    return model, model.transform(docs.where(out)).select(F.col(label).alias("actual"), "predicted")
