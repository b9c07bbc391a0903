"""Each operator against brute force, an exact round trip or known cases, with awkward rows."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from newsflow.llm.shared import binary_batch
from newsflow.llm import byte_bpe, chat_formatting, decontamination, quality_rules, queries, repeated_bytes, repeated_words, secret_scans, simhash, token_counts, toxicity

D = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls, empty and blank texts, ties, repeated rows, one long text; columns that clash with names the operators make.
PROSE = "the cat sat on the mat and looked at the moon until the sun came up over the old grey hill by the sea".split()


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    passage = " ".join(rng.choice(PROSE) + str(rng.randint(0, 9)) for _ in range(70))
    rows = []
    for k in range(n):
        words = [rng.choice(PROSE) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 60))]
        if k % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()[rng.randint(0, 20) : rng.randint(45, 70)]
        rows.append((k, " ".join(words) + rng.choice(["", "\n", "\n\nend é ß 日本"])))
    rows += [(n, rows[4][1]), (n + 1, rows[4][1].upper()), (n + 2, None), (n + 3, ""), (n + 4, " \n\t"), (n + 5, "ab" * 900), (n + 6, "word " * 3000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(5)
    return df.withColumns({"kept": F.lit("x"), "fp": F.lit(1), "key": F.lit("k"), "spans": F.lit(0), "_fp": F.lit(None).cast("int"), "n_words": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_op1_brute_force(docs):
    got, seen = by_id(repeated_words.remove_repeats(docs, window=20)), set()
    for k, text in corpus():
        w = SPLIT.findall(text or "")
        gone = set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone.update(range(i, i + 20))
            seen.add(key)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_text) == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))


def test_op1_repeated_rows(spark, empty):
    text = " ".join(f"w{k}" for k in range(25))
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert sorted(r.n_removed for r in repeated_words.remove_repeats(df).collect()) == [0, 25, 25]
    assert [r.n_removed for r in repeated_words.remove_repeats(df).where("doc_id is null").collect()] == [0]
    assert repeated_words.remove_repeats(empty).collect() == []


@pytest.mark.parametrize(("length", "hot"), [(24, repeated_bytes.HOT), (24, 2), (130, repeated_bytes.HOT), (130, 2)])
def test_op5_brute_force(docs, length, hot):
    """hot=2 deals nearly every repeated anchor by windows."""
    check_op5({k: t or "" for k, t in corpus()}, repeated_bytes.remove_repeats(docs, length=length, hot=hot), length)


@pytest.mark.parametrize("hot", [repeated_bytes.HOT, 6])
def test_op5_documents(spark, hot):
    """The contract's 400 bytes over all documents of sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_op5({r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}, repeated_bytes.remove_repeats(docs, 400, hot=hot), 400)


def check_op5(texts, found, length):
    texts = {k: t.encode() for k, t in texts.items()}
    count = Counter(t[i : i + length] if length < 200 else hash(t[i : i + length]) for t in texts.values() for i in range(len(t) - length + 1))
    got = by_id(found)
    for k, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length] if length < 200 else hash(t[i : i + length])] > 1:
                gone[i : i + length] = True
        edges = int(np.count_nonzero(np.diff(np.concatenate([[0], gone])) == 1))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, bytes(got[k].kept)) == (len(t), int(gone.sum()), edges, kept)


def test_op5_repeated_rows(spark, empty):
    text = "".join(random.Random(2).choice("abcdef") for _ in range(500))
    df = spark.createDataFrame([(1, text), (1, text), (None, "x" + text[:399])], "doc_id long, text string")
    assert sorted(r.n_removed for r in repeated_bytes.remove_repeats(df, 400).collect()) == [0, 500, 500]
    assert repeated_bytes.remove_repeats(empty).collect() == []
    with pytest.raises(ValueError, match="65,535"):
        repeated_bytes.remove_repeats(empty, 70_000)


def test_op5_hot_anchors_are_counted():
    """An anchor that no batch has often, but all together have, is hot."""
    own = np.repeat(np.array([7, 8, 9], np.uint64), [1000, 300, 1])
    given = [binary_batch(["batch", "hashes"], [(k, own.tobytes())]) for k in range(20)]
    sent = [repeated_bytes.rows_of([b]) for b in repeated_bytes._send_hashes(iter(given), 1)]
    rows = [r for rs in sent for r in rs]
    told = repeated_bytes._repeated_anchors(iter([binary_batch(["bucket", "batch", "hashes", "counts"], [tuple(r.values()) for r in rows])]), 6000)
    for batch in told:
        for r in repeated_bytes.rows_of([batch]):
            known, hot = (np.frombuffer(r[c], np.uint64).tolist() for c in repeated_bytes.TOLD[2:4])
            assert known == [7, 8, 9] and hot == [7]


def test_op5_interleave():
    """Merged lists of shards are in order and have the common prefixes that sorting all strings gives."""
    rng = random.Random(5)
    entries = sorted((g, shard, "".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode()) for g in range(4) for shard in range(3) for _ in range(rng.randint(1, 30)))
    groups, shards, strings = np.array([e[0] for e in entries]), np.array([e[1] for e in entries]), [e[2] for e in entries]
    known = repeated_bytes.common_prefixes(strings, groups * 10 + shards)
    order, prefix = repeated_bytes.interleave(strings, np.searchsorted(groups, groups), shards, known)
    expected = sorted(entries, key=lambda e: (e[0], e[2]))
    assert [(entries[k][0], entries[k][2]) for k in order] == [(e[0], e[2]) for e in expected]
    for k in range(1, len(entries)):
        if expected[k][0] == expected[k - 1][0]:
            a, b = expected[k - 1][2], expected[k][2]
            assert prefix[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_op2_awkward_rows(docs, empty):
    got = by_id(quality_rules.clean_lines(docs))
    n = len(corpus()) - 7
    assert got[n + 2].base_failed and got[n + 3].n_words == 0 and not got[n + 4].kept
    assert got[n + 6].n_repeat_words == 3000 and got[n + 6].base_failed
    assert got[n].kept == got[4].kept
    for k, text in corpus()[:30]:
        w = SPLIT.findall(text or "")
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(5)}
        assert (got[k].n_words, got[k].n_repeat_words) == (len(w), len(covered))
    assert quality_rules.clean_lines(empty).collect() == []


def test_op2_lines(spark):
    body = "This sentence has plenty of words that say something about the weather today."
    cases = {1: body, 2: body + "\n" + "Home | News | Sport | Login", 3: "buy## now$$ here%% and&& there** or## else$$ you%% will&& miss** it##", 4: "\n".join(["All rights reserved by somebody or other in many words " + str(k) for k in range(4)])}
    got = by_id(quality_rules.clean_lines(spark.createDataFrame(list(cases.items()), "doc_id long, text string")))
    assert [got[k].kept for k in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[2].cleaned_text == body


def test_op3_grammar():
    s = toxicity.Scorer({"idiot": 2.0}, None)
    at = {name: k for k, name in enumerate(toxicity.OUTPUTS)}
    hit = lambda text: {n for n, k in at.items() if s.features(text)[k] > 0}
    assert hit("you are an idiot.") == {"insult+aimed"}
    assert hit("this is not an idiot") == {"insult+negated+aimed"}
    assert hit("it said: an idiot") == {"insult+reported"}
    assert hit("an idiot. you") == {"insult"}
    assert hit("preidiot") == set() and s.score("") < 0.5
    assert hit("they will kill you") == {"threat+aimed"}


@pytest.mark.parametrize(("text", "found"), [
    ("I will make sure you regret this", {"threat+aimed"}), ("you should die", {"threat+aimed"}), ("you'll regret it", {"threat+aimed"}), ("if you tell anyone, I will hurt you", {"threat+aimed"}), ("we are going to burn all of them", {"threat+aimed"}),
    ("I will not kill you", {"threat+negated+aimed"}), ("I will kill you, he said", {"threat+reported+aimed"}), ("how to kill a process", set()), ("beat the eggs", set()), ("you kill", set()), ("die Stadt ist gross", set()), ("ihr sollt die Tür öffnen", set()),
    ("I am not saying you are an idiot", {"insult+negated+reported+aimed"}), ("idiot, he said", {"insult+reported+aimed"}), ("idiot, it was said", {"insult+reported"}), ("You will never be anything but an idiot", {"insult+aimed"}), ("no, an idiot", {"insult"}), ("the word idiot", set()),
    ("such an idiot, like you", {"insult+aimed"}),
])
def test_op3_patterns(text, found):
    s = toxicity.Scorer({"idiot": 2.0}, None)
    assert {n for n, k in s.place.items() if s.features(text)[k] > 0} == found


def test_op3_composition():
    """The composed machines give what their parts give one after the other, on every short clause."""
    parts = [toxicity.threats(), toxicity.insults(), toxicity.switching("negation", "negated", toxicity.OUTPUTS, "end"), toxicity.switching("report", "reported", toxicity.OUTPUTS), toxicity.switching("target", "aimed", toxicity.OUTPUTS)]
    rng = random.Random(3)
    for _ in range(4000):
        clause = rng.choices(toxicity.SYMBOLS, k=rng.randrange(8))
        out = clause
        for machine in parts:
            state, made = machine.start, []
            for symbol in out:
                state, x = machine.step(state, symbol)
                made.append(x)
            out = made
        matches = [x for x in out if x.split("+")[0] in ("insult", "threat")]
        report, target = ({k for k, x in enumerate(out) if x == name} for name in ("report", "target"))
        for k, (x, y) in enumerate(zip(out, toxicity.read(clause), strict=True)):
            marks = set(x.split("+")[1:]) | {m for m, at in (("reported", report), ("aimed", target)) if any(j > k for j in at)} if x.split("+")[0] in ("insult", "threat") else set()
            assert y == ("+".join([x.split("+")[0], *(m for m in toxicity.MARKS if m in marks)]) if marks else x)
        assert len(matches) == sum(y.split("+")[0] in ("insult", "threat") for y in toxicity.read(clause))


def test_op3_very_long_texts():
    """Clauses are walked once: five million characters with one kind of delimiter, and as many without any."""
    s, begun = toxicity.Scorer({"idiot": 2.0}, None), time.time()
    some = s.features("you are an idiot. the cat sat on the mat. " * 120_000)
    assert s.features("you idiot " * 500_000).sum() > some.sum() * 0 and time.time() - begun < 60
    few = s.features("you are an idiot. the cat sat on the mat. " * 12)
    assert np.allclose(np.expm1(some)[:-1], np.expm1(few)[:-1] * 10_000)


def test_op3_learns(spark, empty):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(PROSE) for _ in range(30)) + (" you zorgling fool " if k % 5 == 0 else " ") + str(k)) for k in range(400)]
    docs, labels = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string"), spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    toxicity.shared_folder(spark)
    got = toxicity.score(docs, *toxicity.learn(docs, labels)).where("doc_id is not null").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 5 == 0) for r in got)
    assert toxicity.learn(docs, labels.where("false")) == ({}, None)
    assert toxicity.score(empty, {}, None).collect() == []


def plain_print(text, n=3):
    w = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(prints, radius=3):
    ids, root = list(prints), {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def test_one_of_each(spark, docs, empty):
    rng = random.Random(8)
    texts = {}
    for g in range(12):
        words = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([3, 40, 200, 9000]))]
        for k in range(6):
            texts[g * 10 + k] = " ".join(w if rng.random() > k * 0.004 else "changed" for w in words)
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").withColumn("fp", F.lit(0)).repartition(4)
    roots = jaccard_groups(texts)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    kept = {r.doc_id for r in got.collect()}
    assert kept == {k for k, v in roots.items() if k == v}
    assert {k for k in texts if k % 10 == 0} <= kept and len(kept) < len(texts) / 2
    assert simhash.one_of_each(empty).collect() == []
    texts = dict(corpus())
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {k for k, v in jaccard_groups(texts).items() if k == v}


def jaccard_groups(texts, similarity=0.8):
    """Each id's least connected id, by the shingle sets of all pairs."""
    sets, root = {}, {k: k for k in texts}
    for k, text in texts.items():
        w = SPLIT.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        sets[k] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    for a in texts:
        for b in texts:
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("most", [simhash.TOGETHER, 7, 1])
def test_one_of_each_brute_force(spark, most):
    """Families around a shared passage stay, copies just above the similarity go, in whatever parts groups are compared."""
    rng = random.Random(10)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    shared = words(170)
    texts = {k: " ".join(shared + words(45)) for k in range(150)}
    for g in range(40):
        base = words(rng.choice([12, 60, 204]))
        texts[1000 + 10 * g] = " ".join(base)
        for k in range(1, 4):
            texts[1000 + 10 * g + k] = " ".join(base + words(max(1, len(base) * k // 16)))
    texts |= {2000: "", 2001: None, 2002: " "}
    roots = jaccard_groups(texts)
    assert sum(v == k for k, v in roots.items() if k < 1000) == 150 and sum(v == k for k, v in roots.items()) < 250
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.one_of_each(df, cell=most, together=most).collect()}
    assert kept == {k for k, v in roots.items() if k == v}


def test_one_of_each_documents(spark):
    """The given documents, as the pipeline's stage gets them."""
    texts = {r.doc_id: r.cleaned_text for r in quality_rules.clean_lines(spark.read.parquet(f"{D}/documents.parquet")).collect() if r.kept}
    docs, roots = spark.createDataFrame([*texts.items()], "doc_id long, text string"), jaccard_groups(texts)
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {k for k, v in roots.items() if k == v}


def test_near_links():
    """They connect what pairs within the radius connect, in a cell of groups and strangers; labels are not compared within."""
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2**63, (9, simhash.WIDE), np.uint64)
    fp = centres[rng.integers(0, 9, 400)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (400, simhash.WIDE, 6), np.uint64), axis=2)
    fp = np.unique(np.concatenate([fp, rng.integers(0, 2**63, (60, simhash.WIDE), np.uint64)]), axis=0)
    prints = {k: int.from_bytes(row.tobytes(), "little") for k, row in enumerate(fp)}
    expected = groups(prints, 44)
    for label in (np.arange(len(fp)), np.array([expected[k] if k % 3 else k for k in prints])):
        root = {k: int(label[k]) for k in prints}
        for a, b in simhash.near_links(fp, label, np.ones(len(fp), bool), 44):
            assert root[a] != root[b]
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
        assert root == expected


def test_op4_brute_force(docs, empty):
    got = by_id(simhash.near_duplicates(docs, shingle=3))
    prints = {k: plain_print(t) for k, t in corpus()}
    assert {k: r.fp % 2**64 for k, r in got.items()} == prints
    assert {k: r.component_id for k, r in got.items()} == groups(prints)
    assert simhash.near_duplicates(empty).collect() == []


def test_op4_chains(spark):
    """Links that only meet through others, in every pair of blocks."""
    rng = random.Random(6)
    prints, x = {}, rng.getrandbits(64)
    for k in range(300):
        prints[k] = x
        x = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if k % 10 else rng.getrandbits(64)
    signed = {k: v - 2**64 if v >> 63 else v for k, v in prints.items()}
    classes = spark.createDataFrame([(v,) for v in set(signed.values())], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(classes)).collect()}
    mine = {k: root.get(v, v) for k, v in signed.items()}
    expected = groups(prints)
    assert len({*mine.values()}) == len({*expected.values()}) == len({(mine[k], expected[k]) for k in mine})


def test_op4_dense_cells(spark):
    """Fingerprints of one template that share two blocks: cells are cut again, twice, and no link is lost."""
    rng = random.Random(16)
    fixed, prints = rng.getrandbits(64), set()
    for family in range(3):
        free = [*range(26, 64)] if family < 2 else [*range(50, 64)]
        for _ in range(250):
            prints.add(fixed ^ sum(1 << b for b in rng.sample(free, rng.randrange(1, 9))) ^ (family << 3))
    signed = {k: v - 2**64 if v >> 63 else v for k, v in enumerate(sorted(prints))}
    classes = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    expected = groups(dict(enumerate(sorted(prints))))
    for most in (simhash.BIT_CELL, 20):
        root = {r.node: r.root for r in simhash.components(simhash.links(classes, most=most)).collect()}
        mine = {k: root.get(v, v) for k, v in signed.items()}
        assert len({*mine.values()}) == len({*expected.values()}) == len({(mine[k], expected[k]) for k in mine})


def test_op4_cells_are_bounded():
    """What is cut three times leaves 14 free bits, whichever pairs of blocks are equal."""
    assert [len(simhash.free_bits(0, level, 3)) for level in range(4)] == [64, 38, 23, 14]
    assert max(len(simhash.free_bits(a + 10 * b + 100 * c, 3, 3)) for a in range(10) for b in range(10) for c in range(10)) <= 16


def test_op4_null_and_repeated_ids(spark):
    rows = [(None, "one two three four"), (None, "one two three four"), (5, "one two three four"), (5, "entirely other words stand here"), (9, None), (None, "alone in the world today")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(None, 5), (None, 5), (5, 5), (5, 5), (9, 9), (None, None)])


def test_op6(spark):
    rows = [(1, 0, "a", "Hello there world\nsecond line is here"), (1, 1, "b", "> Hello there   World\nI agree with that"), (1, 2, "a", "On Monday b wrote:\n>> hello there world\n> i AGREE with that\nno"), (1, 3, "c", "> i agree with that\n>> Hello there world\nYes indeed, fine"),
            (1, 4, "d", "> Yes indeed, fine\nok"), (1, None, "e", None), (None, 2, "f", "> nothing at all here"), (1, 4, "d", "> Yes indeed, fine\nok"), (2, 0, "x", "> Hello there world\nother place")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    got = sorted(((r.conv_id or 0, -1 if r.turn is None else r.turn, r.text, r.reply_to, r.thread, r.depth) for r in chat_formatting.link(df).collect()), key=str)
    expected = [(0, 2, "", None, 2, 0), (1, -1, "", None, None, 0), (1, 0, "Hello there world\nsecond line is here", None, 0, 0), (1, 1, "I agree with that", 0, 0, 1), (1, 2, "no", 1, 0, 2), (1, 3, "Yes indeed, fine", 1, 0, 2), (1, 4, "ok", 3, 0, 3), (1, 4, "ok", 3, 0, 3), (2, 0, "other place", None, 0, 0)]
    assert got == sorted(expected, key=str)
    assert chat_formatting.link(df.where("false")).collect() == []


def test_op6_places(spark):
    """Every message is followed by its replies before the next sibling comes; deep chains, many siblings, several threads."""
    rng, rows, replies = random.Random(8), [], {}
    for conv in range(6):
        for turn in range(60):
            to = None if turn == 0 or rng.random() < 0.1 else turn - 1 if conv == 0 else 0 if conv == 1 else rng.randrange(turn)
            text = f"message number {turn} of {conv} stands here" if to is None else f"> message number {to} of {conv} stands here\nmessage number {turn} of {conv} stands here"
            rows.append((conv, turn, "r", text))
            replies[conv, turn] = to
    rows += [(9, None, "r", "no turn"), (9, 1, "r", "x" * 300_000 + "\n> short"), (9, 1, "r", "again")]
    linked = chat_formatting.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash")).repartition(5)).checkpoint()
    got = {(r.conv_id, r.turn): r for r in linked.where("conv_id < 9").collect()}
    assert {k: r.reply_to for k, r in got.items()} == replies
    order = {}
    for conv in range(6):
        order[conv] = []

        def walk(turn, place, conv=conv):
            begun = place
            order[conv].append(turn)
            assert got[conv, turn].place == place
            for child in sorted(t for (c, t), to in replies.items() if c == conv and to == turn):
                place = walk(child, place + 1)
            return place if place >= begun else begun

        for root in sorted(t for (c, t), to in replies.items() if c == conv and to is None):
            walk(root, 0)
    whole = {r.conv_id: r for r in chat_formatting.conversations(linked).collect()}
    assert all([m.turn for m in whole[c].messages] == turns and whole[c].n_messages == 60 for c, turns in order.items())
    assert [m.turn for m in whole[9].messages] == [None, 1, 1]


def test_op7(spark, empty):
    key = "AKIA" + "Q" * 16
    texts = {1: f"use {key} with password='Abcdefgh1234567' at https://db.example.com:5432/x", 2: "password=short1 alone", 3: "login: someone_here\npassword=short1", 4: "token=secret: abcdefghijklmno", 5: None, 6: "é " * 50 + "deadbeefdeadbeef0 x", 7: "see https://example.com only", 8: "pass" * 20000}
    df = spark.createDataFrame([*texts.items(), (3, texts[3])], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in secret_scans.scan(df).withColumn("w", secret_scans.written(F.col("spans"))).withColumn("s", secret_scans.written(F.col("strong"))).collect()}
    t = texts[1]
    a, p, e = t.index("AKIA"), t.index("password"), t.index("https")
    assert got[1].w == f"access:{a}:{a + 20},assign:{p}:{p + 25},endpoint:{e}:{len(t)}"
    assert [got[k].w for k in (2, 5, 7, 8)] == [""] * 4
    assert got[3].s == "" and got[3].w == "account:0:19,value:20:35"
    assert got[4].s == "" and got[6].s == "hex:100:117"
    assert "[access]" in secret_scans.redact(df).where("doc_id = 1").first().text
    assert secret_scans.redact(df).count() == 9 and secret_scans.scan(empty).collect() == []


def plain_secrets(text):
    """(base parts, all reported spans) by Python's expressions and by comparing all parts of a text."""
    text, base, weak = text or "", [], []
    rank, role = secret_scans.KINDS.index, {"access": "id", "account": "id", "endpoint": "endpoint"}
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 12:
            base.append((m.start(), rank("assign"), m.end()))
        elif len(m[2]) >= 6:
            weak.append((m.start(), rank("value"), m.end()))
    base += [(m.start(), rank("access"), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), rank("hex"), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    for kind, pattern in (("account", secret_scans._ACCOUNT), ("token", secret_scans._MIXED), ("endpoint", secret_scans._ENDPOINT)):
        weak += [(m.start(), rank(kind), m.end()) for m in re.finditer(pattern, text)]
    of = lambda p: role.get(secret_scans.KINDS[p[1]], "secret")
    kept = {w for w in weak for p in base + weak if of(w) != of(p) and max(w[0] - p[2], p[0] - w[2]) <= 160}
    say = lambda parts: ",".join(f"{secret_scans.KINDS[k]}:{a}:{b}" for a, k, b in sorted(parts))
    return say(base), say([*base, *kept]), sorted([*base, *kept])


def test_op7_brute_force(spark):
    rng, key = random.Random(7), lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    alpha = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    makers = [
        lambda: f"{rng.choice(['password', 'API_KEY', 'Token', 'apikey'])}{rng.choice(['=', ': ', '\\": \\"', ' :'])}{key(rng.randint(3, 20), alpha)}", lambda: "AKIA" + key(rng.randint(8, 20), alpha.upper()), lambda: key(rng.randint(10, 30), "0123456789abcdef"), lambda: f"login: {key(6, alpha)}",
        lambda: key(rng.choice([19, 20, 43, 81, 200]), alpha) + rng.choice(["", "=", "=="]), lambda: f"https://{key(5, alpha)}.example:80/x", lambda: "é" * rng.randint(1, 200), lambda: "plain words, " * rng.randint(1, 12), lambda: "\n",
    ]
    texts = {k: " ".join(rng.choice(makers)() for _ in range(rng.randint(0, 12))) for k in range(400)}
    texts[400] = " ".join(key(16, "0123456789abcdef") + (" login: abcdef" if k % 50 == 0 else "") for k in range(12_000))
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.base, r.all) for r in secret_scans.scan(df).select("doc_id", secret_scans.written(F.col("strong")).alias("base"), secret_scans.written(F.col("spans")).alias("all")).collect()}
    clean = {r.doc_id: r.text for r in secret_scans.redact(df).collect()}
    assert sum(b != a for a, b in got.values()) > 50
    for k, text in texts.items():
        base, spans, parts = plain_secrets(text)
        assert got[k] == (base, spans)
        out, at = [], 0
        for a, kind, b in parts:
            if a >= at:
                out += [text[at:a], f"[{secret_scans.KINDS[kind]}]"]
            at = max(at, b)
        assert clean[k] == "".join(out) + text[at:]


def test_op7_documents(spark):
    """The query's base columns over all documents of sf0.01."""
    d = "/root/testdata/sf0.01"
    got = by_id(secret_scans.op7_secret_scans(spark, d))
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        base, spans, _ = plain_secrets(r.text)
        x = got[r.doc_id]
        assert (x.base_sha256, x.spans, x.n_assign, x.n_access, x.n_hex) == (hashlib.sha256(base.encode()).hexdigest(), spans, *(len(re.findall(rf"\b{k}:", base)) for k in ("assign", "access", "hex")))


def test_op6_brute_force(spark):
    """Generated threads with whole, trimmed and nested quotes; links by looking at all earlier messages."""
    rng, rows = random.Random(6), []
    norm = lambda x: re.sub(r"\s+", " ", x.lower()).strip()
    for conv in range(30):
        said = []
        for turn in range(25):
            own = [" ".join(rng.choice(PROSE) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4))]
            lines = []
            for _ in range(rng.randint(0, 2) if said else 0):
                quoted, level = rng.choice(said), rng.randint(1, 3)
                a = rng.randrange(len(quoted))
                lines += [">" * level + " " + x.upper() for x in quoted[a : a + rng.randint(1, 4)]] + ["ok"]
            rows.append((conv, turn, "\n".join(lines + own)))
            said.append(own)
    got = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.reply_to) for r in chat_formatting.link(spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("r"))).collect()}
    first, expected = {}, {}

    def units(text):
        lines = [x for x in map(norm, text.split("\n")) if x]
        more = [(1, " ".join(p)) for p in itertools.pairwise(lines)] + [(2, x) for x in lines] if len(lines) > 1 else []
        return [(0, " ".join(lines)), *more]

    for conv, turn, text in rows:
        runs = [(level, "\n".join(re.sub(r"^>+ ?", "", x) for x in part)) for level, part in itertools.groupby(text.split("\n"), lambda x: len(re.match(">*", x)[0]))]
        linked = []
        for level, passage in runs:
            votes = Counter((kind, first[conv, u]) for kind, u in set(units(passage)) if level and len(u) >= 8 and (conv, u) in first)
            if votes:
                kind, _, original = min((kind, -n, o) for (kind, o), n in votes.items())
                linked.append((level, -original))
        expected[conv, turn] = (sum(level > 0 for level, _ in runs), len(linked), -min(linked)[1] if linked else None)
        own = [passage for level, passage in runs if not level]
        for u in [norm("\n".join(own)), *(u for p in own for _, u in units(p))]:
            if len(u) >= 8:
                first.setdefault((conv, u), turn)
    assert got == expected and sum(n for _, n, _ in expected.values()) > 200


def test_op8(spark, empty):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    item = words(30)
    changed = list(item)
    for k in (4, 13, 22):
        changed[k] = "other"
    rows = {1: words(50) + item + words(9), 2: words(50) + changed + words(9), 3: words(200), 4: words(20) + item[:22], 5: item[:11] + words(30)}
    docs = spark.createDataFrame([(k, " ".join(v).upper()) for k, v in rows.items()] + [(6, None), (None, " ".join(item)), (1, " ".join(rows[1]))], "doc_id long, text string").withColumn("h", F.lit(1))
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.doc_at) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(1, 7, 50), (2, 7, 50), (4, 7, 20), (None, 7, 0)}
    assert decontamination.leaks(empty, items).collect() == [] and decontamination.leaks(docs, items.where("false")).collect() == []


def test_op8_many_items(spark, monkeypatch):
    """Items of equal tokens are looked for once, more seeds than are broadcast are joined by shuffles, and no row holds a filter."""
    rng = random.Random(88)
    texts = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(30)) for _ in range(3)]
    docs = spark.createDataFrame([(k, f"a b {texts[k % 3]} c") for k in range(6)] + [(6, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(k, texts[k % 2].upper() + "." * k) for k in range(8)] + [(0, texts[2]), (None, texts[2])], "item_id long, text string")
    expected = {(k, i, 2, 20, 20) for k in range(6) for i in ({0, 2, 4, 6}, {1, 3, 5, 7}, {0, None})[k % 3]}
    assert set(map(tuple, decontamination.leaks(docs, items).collect())) == expected
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 10)
    found = decontamination.leaks(docs, items)
    assert set(map(tuple, found.collect())) == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "_bits#" not in plan


def test_op8_masks():
    """Enumeration: whichever tokens are substituted within the tolerance, a seed of some mask is left."""
    for width in range(1, 21):
        changed = max(k for k in range(width) if width - k >= 0.8 * width)
        places = [{a + k for k in m} for m in decontamination.masks_of(width, 0.8) for a in range(width - m[-1])]
        assert all(any(p.isdisjoint(c) for p in places) for c in itertools.combinations(range(width), changed)), width
    # beyond enumeration: runs between substitutions at equal distances
    (run,) = decontamination.masks_of(60, 0.8)
    assert run == tuple(range(len(run))) and (len(run) - 1) * 13 + 12 < 60


@pytest.mark.parametrize("width", [1, 2, 4, 5, 9, 11, 12, 15, 20, 33])
def test_op8_substitutions(spark, width):
    """Verbatim and substituted copies of items of every length, and one substitution more than is tolerated."""
    rng = random.Random(width)
    item, n = [f"i{k}" for k in range(width)], min(width, 20)
    most = max(k for k in range(n) if n - k >= 0.8 * n)
    rows, expected = {}, set()
    for k in range(40):
        changed = rng.sample(range(n), most + (k % 4 == 3)) if k else []
        if k == 1 and n == 20:
            changed = [0, 8, 10, 15]
        rows[k] = [f"a{rng.random()}"[:9] for _ in range(5)] + [f"x{i}" if i in changed else w for i, w in enumerate(item[:n])] + ["end"]
        if len(changed) <= most:
            expected.add(k)
    docs = spark.createDataFrame([(k, " ".join(w.replace(".", "") for w in v)) for k, v in rows.items()], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "")], "item_id long, text string")
    assert {r.doc_id for r in decontamination.leaks(docs, items).collect()} == expected


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.public_vocabulary()


def test_op9_round_trip(docs, empty, vocabulary):
    bpe = byte_bpe.codec(*vocabulary)
    reference = tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(9)
    texts = [t or "" for _, t in corpus()] + ["".join(rng.choice("abc def's \n\t日本語éß١½²<|>!?😀") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["a" * 2000, "xy" * 400 + "é" * 300]
    assert bpe.encode_many(texts) == [reference.encode_ordinary(t) for t in texts]
    encoded = byte_bpe.encode(docs, *vocabulary)
    assert {k: bytes(r.bytes).decode() for k, r in by_id(byte_bpe.decode(encoded, *vocabulary)).items()} == {k: t or "" for k, t in corpus()}
    assert byte_bpe.encode(empty, *vocabulary).collect() == []


def test_op10(spark, docs, empty, vocabulary):
    files, names = token_counts.pack(docs, *vocabulary)
    got = {r.doc_id: r.n_tokens for r in names.join(token_counts.counts(token_counts.token_blocks(files, 64), group=3), ["file", "nth"]).collect()}
    assert got == {r.doc_id: r.n_tokens for r in byte_bpe.digests(docs, *vocabulary).collect()}
    files, names = token_counts.pack(empty, *vocabulary)
    assert names.count() == 0 and token_counts.counts(token_counts.token_blocks(files)).count() == 0


@pytest.mark.parametrize("kind", [np.uint16, np.uint32])
def test_op10_flat_files(spark, tmp_path, kind):
    """Files of any size: not a multiple of a block, empty, ending without a separator or with one."""
    end, rng, expected = token_counts.END, random.Random(10), {}
    for name, n in {"a": 5, "b": 0, "c": 40, "d": 1}.items():
        lens = [rng.choice([0, 1, 3, 64, 700]) for _ in range(n)]
        rest = 5 if name == "c" else 0
        flat = np.array([x for k in lens for x in [7] * k + [end]] + [9] * rest, kind)
        (tmp_path / f"{name}.bin").write_bytes(flat.tobytes())
        expected[f"{name}.bin"] = lens + [5] * (rest > 0)
    width = np.dtype(kind).itemsize
    blocks = token_counts.token_blocks(token_counts.flat_files(spark, str(tmp_path), width), 64)
    got = defaultdict(list)
    for r in token_counts.counts(blocks, group=2).orderBy("nth").collect():
        got[r.file.rpartition("/")[2]].append(r.n_tokens)
    assert dict(got) == {k: v for k, v in expected.items() if v}
    (tmp_path / "e.bin").write_bytes(b"\0" * (width + 1))
    with pytest.raises(Exception, match="ends within an id"):
        token_counts.counts(token_counts.token_blocks(token_counts.flat_files(spark, str(tmp_path / "e.bin"), width), 64)).collect()


def test_queries_are_registered():
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_clean_documents_stay(spark):
    """Rows with quality 1 that don't fail the base are kept."""
    good = {r.doc_id for r in spark.read.parquet(f"{D}/labels.parquet").where("quality = 1").collect()}
    kept = [r.kept for r in quality_rules.op2_quality_rules(spark, D).collect() if r.doc_id in good and not r.base_failed]
    assert kept.count(False) <= 0.02 * len(kept)


def test_groups_of_words_are_linked(spark):
    """defaultdict of classes: exact copies always share a component."""
    got, texts = simhash.op4_simhash(spark, D).collect(), defaultdict(set)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    for r in got:
        texts[text[r.doc_id]].add(r.component_id)
    assert all(len(v) == 1 for v in texts.values())
