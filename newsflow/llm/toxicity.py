"""Operator 3: toxicity by a weighted finite-state pattern grammar.

Transducers over the word classes of a clause are composed into two machines. The first reads
a clause forwards: the threat transducer turns patterns (violence against a target, somebody's
fate behind a modal or in the speaker's intent) into threats, the insult transducer drops
insults that are only mentioned, negation marks what stands in its scope, which ends at a comma
or a conjunction, reported speech what follows a verb of saying or a quotation mark, a target
what follows it. The second reads that output backwards, since speech is also reported, and
targets named, behind a match. Each matched insult or threat leaves the machines with its marks
and its lexical weight; the sums by mark are the features of a document and a logistic model
turns them into a score. Isolated words count through their clause only.

The lexicon of insults is learned from labelled rows: word stems (the first three to eight
letters) whose document frequency among toxic rows is significantly higher, all that pass the
test; of stems that begin with one another the most significant. At most ``SAMPLE`` labelled
rows are used, those with the least hash of doc_id, so that the sample doesn't depend on order
or partitions; it bounds the lexicon, too, since a stem has to occur in several of its toxic rows.

Defined results: null and empty texts score like texts without matches; a null doc_id is
never labelled and counts as held out; a doc_id with several labels is toxic if one says so;
without any labels the weights are the built-in ones; empty tables give no rows; other columns are
not read. Clauses of very long texts are walked once, from left to right.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.shared import arrow_session, shared_folder

SAMPLE = 12_000
#: Fixed seed words of the classes, in the four languages of the corpus.
VIOLENCE = "kill hurt destroy beat attack burn shoot töten verletzen zerstören schlagen tuer blesser détruire frapper matar herir destruir golpear".split()
FATES = "regret suffer perish bereuen sterben leiden regretter mourir souffrir lamentar morir sufrir".split()
#: Also an article in one of the languages, so it counts at the end of a clause only.
LAST_FATE = "die"
FIRST = "i we ich wir je nous yo nosotros".split()
MODALS = "will would shall should must gonna going werde werden wird sollst sollte musst vais allons vas devrais dois voy vamos deberías debes".split()
CONDITIONS = "if unless wenn falls si".split()
THINGS = "a an the my our its ein eine einen einem der das den dem le la les l un une des el los las una unos".split()
MENTIONS = "word term wort begriff mot terme palabra término".split()
TARGETS = "you your yours yourself them they he she him her this these du dich dir ihr euch sie tu toi te vous il elle ils usted ustedes tú él ella ellos".split()
NEGATIONS = "not no never don't doesn't isn't aren't won't nicht kein keine nie pas jamais aucun nunca ni sin".split()
SCOPE_ENDS = ", ; but because although however aber sondern weil mais car pero sino porque".split()
REPORTS = 'said says say saying called calls calling quoted wrote writes reported claims sagte sagt schrieb nannte dit écrit appelle dijo dice llamó escribió "'.split()
QUOTES = '"“”«»„'
CLAUSE_END = re.compile(r"[.!?;\n]")
TOKEN = re.compile(rf"[\w'’]+|[,{QUOTES}]")
AT_END = re.compile(r"[^\w.!?;\n]*(?:[.!?;\n]|\Z)")
WILL = re.compile(r"['’]ll\b")
STEM = range(8, 2, -1)
MARKS = ("negated", "reported", "aimed")


class Transducer:
    """Deterministic: arcs[(state, symbol)] = (state, output). What has no arc goes to ``other`` of its state and comes out as it was."""

    def __init__(self, start, arcs: dict, other: dict):
        self.start, self.arcs, self.other = start, arcs, other

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.other[state], symbol)


def marked(name: str, mark: str) -> str:
    """The name with one more mark, marks in their order."""
    base, *marks = name.split("+")
    return "+".join([base, *(m for m in MARKS if m == mark or m in marks)])


def switching(trigger: str, mark: str, base: tuple[str, ...], end: str | None = None) -> Transducer:
    """Behind a trigger matches carry the mark, up to an end symbol or, without one, to the end of the clause."""
    arcs = {(k, trigger): (1, trigger) for k in (0, 1)}
    arcs |= {(1, b): (1, marked(b, mark)) for b in base}
    if end is not None:
        arcs[(1, end)] = (0, end)
    return Transducer(0, arcs, {0: 0, 1: 1})


def insults() -> Transducer:
    """An insult that is only mentioned (the word ...) is none."""
    arcs = {(k, "mention"): (1, "mention") for k in (0, 1)} | {(1, "insult"): (0, "other")}
    return Transducer(0, arcs, {0: 0, 1: 0})


def threats() -> Transducer:
    """Clauses that threaten leave the machine as a threat where they are complete.

    Patterns: violence against a target (up to two words between, but no article: what is done
    to a thing is no threat); somebody's fate after a modal or in what the speaker intends; a
    fate under a condition. Violence of a target itself is an accusation, not a threat, unless
    a modal announces it.
    """
    arcs = {}

    def put(state: str, **to: str) -> None:
        for symbol, target in to.items():
            arcs[(state, symbol)] = (target.removesuffix("!"), "threat") if target.endswith("!") else (target, symbol)

    start = {"first": "speaker", "violence": "act", "target": "target", "condition": "condition", "end": "idle"}
    put("idle", **start)
    put("condition", **start | {"end": "condition", "fate": "idle"})
    put("speaker", **start | {"modal": "intent"})
    put("intent", **start | {"first": "intent", "target": "meant", "thing": "intent"})
    put("meant", **start | {"modal": "doomed", "fate": "idle!", "violence": "idle!", "target": "meant"})
    put("target", **start | {"modal": "doomed", "fate": "idle!", "violence": "idle"})
    put("doomed", **start | {"fate": "idle!", "target": "doomed", "violence": "act", "first": "doomed", "end": "doomed"})
    for state in ("act", "act1", "act2"):
        put(state, **start | {"thing": "idle"})
        arcs[(state, "target")] = ("idle", "threat+aimed")
    other = {s: s for s in ("idle", "condition", "speaker", "intent", "meant", "target", "doomed")} | {"act": "act1", "act1": "act2", "act2": "idle"}
    return Transducer("idle", arcs, other)


def compose(first: Transducer, second: Transducer, symbols: tuple[str, ...]) -> Transducer:
    """One transducer that does first, then second, over the given input symbols."""
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in symbols:
            a, middle = first.step(state[0], symbol)
            b, out = second.step(state[1], middle)
            arcs[(state, symbol)] = ((a, b), out)
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return Transducer(start, arcs, {s: s for s in seen})


SYMBOLS = ("other", "insult", "violence", "fate", "first", "modal", "condition", "thing", "mention", "target", "negation", "report", "end")
_BASE = ("insult", "threat")
#: Every match with every set of marks.
OUTPUTS = tuple("+".join([b, *(m for k, m in enumerate(MARKS) if bits >> k & 1)]) for b in _BASE for bits in range(1 << len(MARKS)))


@cache
def grammar() -> tuple[Transducer, Transducer]:
    """Two machines: one reads a clause forwards, the other one its output backwards. What reports or is aimed at may stand before a match or behind it."""
    forwards = [threats(), insults(), switching("negation", "negated", OUTPUTS, "end"), switching("report", "reported", OUTPUTS), switching("target", "aimed", OUTPUTS)]
    first = forwards[0]
    for machine in forwards[1:]:
        first = compose(first, machine, SYMBOLS)
    second = compose(switching("report", "reported", OUTPUTS), switching("target", "aimed", OUTPUTS), (*SYMBOLS, *OUTPUTS))
    return first, second


def read(symbols: list[str]) -> list[str]:
    """What the machines make of a clause's symbols, place by place. A threat is complete at its target, which aims it."""
    first, second = grammar()
    for machine in (first, second):
        state, out = machine.start, []
        for symbol in symbols:
            state, made = machine.step(state, symbol)
            out.append(made)
        symbols = out[::-1]
    return symbols


class Scorer:
    """Features and scores of texts under a lexicon {word: weight} and model weights."""

    def __init__(self, lexicon: dict[str, float], model: list[float] | None):
        self.weight = {**dict.fromkeys([*VIOLENCE, *FATES, LAST_FATE], 1.0), **lexicon}
        classes = {"violence": VIOLENCE, "fate": [*FATES, LAST_FATE], "insult": lexicon, "first": FIRST, "modal": MODALS, "condition": CONDITIONS, "thing": THINGS, "mention": MENTIONS, "target": TARGETS, "negation": NEGATIONS, "end": SCOPE_ENDS, "report": [*REPORTS, *QUOTES]}
        self.symbol = {w: name for name, words in classes.items() for w in words}
        self.learned = set(lexicon)
        self.model = None if model is None else np.array(model)
        self.finder = ahocorasick.Automaton()
        for word in self.weight:
            self.finder.add_word(word, len(word))
        self.finder.make_automaton()
        self.place = {name: k for k, name in enumerate(OUTPUTS)}

    def features(self, text: str) -> np.ndarray:
        """Sums of lexical weight by output, then the number of matches and of distinct ones, all on a log scale."""
        low = text.lower()
        sums, words, n, until, start = np.zeros(len(OUTPUTS) + 2), set(), 0, -1, 0
        ends = CLAUSE_END.finditer(low)
        for end, size in self.finder.iter(low):
            begin = end - size + 1
            if begin < until or (begin and low[begin - 1].isalnum()) or (size == len(LAST_FATE) and low[begin : end + 1] == LAST_FATE and LAST_FATE not in self.learned and AT_END.match(low, end + 1) is None):
                continue
            while until <= end:  # clauses are walked once, along the matches
                start = until + 1
                stop = next(ends, None)
                until = stop.start() if stop else len(low)
            tokens = TOKEN.findall(WILL.sub(" will", low[start:until]))
            found = [token if token in self.symbol else next((token[:k] for k in STEM if token[:k] in self.weight and token[:k] != LAST_FATE), token) for token in tokens]
            symbols = [self.symbol.get(w, "other") if w != LAST_FATE or k == len(found) - 1 else "other" for k, w in enumerate(found)]
            for word, out in zip(found, read(symbols), strict=True):
                if out in self.place:
                    threat = out.startswith("threat")
                    sums[self.place[out]] += 1.0 if threat else self.weight[word]
                    words.add("threat" if threat else word)
                    n += 1
        sums[-2], sums[-1] = n, len(words)
        return np.log1p(sums)

    def score(self, text: str) -> float:
        x = self.features(text)
        z = float(self.model[0] + x @ self.model[1:]) if self.model is not None else float(-2 + 3 * x.sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> list[float]:
    """Newton's method with an L2 penalty on everything but the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.r_[1e-6, np.ones(x.shape[1] - 1)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def held_out(doc_id="doc_id"):
    """crc32 of doc_id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _sample_features(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(lexicon, None)
    for batch in batches:
        rows = [scorer.features(t or "").tolist() for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], list[float] | None]:
    """The lexicon and the model weights, from at most ``sample`` labelled rows that are not held out."""
    arrow_session(docs.sparkSession)
    chosen = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text").checkpoint()
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, t = int(total["n"]), int(total["t"])
    if not 0 < t < n:
        return {}, None
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}'’]+"), lambda w: F.length(w) >= STEM[-1])
    stems = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(STEM[-1]), F.least(F.length(w), F.lit(STEM[0]))), lambda k: w.substr(F.lit(1), k)))))
    freq = rows.select("toxic", F.explode_outer(stems).alias("w")).groupBy("w").agg(F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("c"))
    share = F.lit(t / n)
    z = (F.col("a") - F.col("c") * share) / F.sqrt(F.col("c") * share * (1 - share))
    gain = F.log((F.col("a") + 0.5) / (F.col("c") - F.col("a") + 0.5)) - math.log((t + 0.5) / (n - t + 0.5))
    best = freq.where("w is not null").where(F.col("a") >= max(5, t / 150)).withColumn("z", z).withColumn("gain", gain).where("z >= 6 and gain >= 2")
    found: dict[str, float] = {}
    for r in best.orderBy(F.desc("z"), F.desc(F.length("w")), "w").collect():
        kin = any(r["w"].startswith(x) or x.startswith(r["w"]) for x in found)
        if not kin and r["w"] not in {*TARGETS, *NEGATIONS, *REPORTS, *THINGS, *SCOPE_ENDS}:
            found[r["w"]] = float(r["gain"])
    data = rows.mapInArrow(partial(_sample_features, lexicon=found), "toxic int, x array<double>").collect()
    return found, fit_logistic(np.array([r["x"] for r in data]), np.array([r["toxic"] for r in data], float))


def _scores(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float], model: list[float] | None) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(lexicon, model)
    for batch in batches:
        scores = [scorer.score(t or "") for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, lexicon: dict[str, float], model: list[float] | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score."""
    arrow_session(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_scores, lexicon=lexicon, model=model), "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    shared_folder(spark)
    scored = score(docs, *learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
