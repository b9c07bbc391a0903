"""Operator 11 against nested dictionaries, with awkward rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from newsflow.llm import prefix_trie, queries


def ordered(rows):
    """conv_id -> [(role, text)], from (conv_id, turn, role, text)."""
    out = defaultdict(list)
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    full = [(c, t, r or "", x or "") for c, t, r, x in rows if c is not None]
    for c, _, r, x in sorted(full, key=lambda q: (q[0], q[1] is not None, q[1] or 0, digest(*q[2:]))):
        out[c].append((r, x))
    return dict(out)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[h:]
    return out


def brute(convs):
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            path = tuple(convs[c][:d])
            members[path].append(c)
            if d:
                children[path[:-1]].add(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, held in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(held) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (held[0], len(path), members[path[:-1]][0] if path else None, len(held), len(children[path]), leaves[path], saved[path],
         hashlib.sha256(",".join(str(c) for c in held if len(convs[c]) == len(path)).encode()).hexdigest())
        for path, held in members.items()
    )


def collected(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(seed=1, n=300):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -5, -100, -150, 2**40, 777, 900]:
        for t in range(rng.choice([0, 1, 2, 3, 3, 4, 8])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello", "é日😀", "", None, "x" * 50, "y" * 5000])))
    rows += [(c, t, "user", f"copy {t}") for c in range(2000, 2400) for t in range(4)]
    rows += [(3000, None, "user", "first"), (3000, 5, "user", "tie b"), (3000, 5, "user", "tie a"), (3000, 5, "user", "tie a"), (None, 1, "user", "lost")]
    rows += [(c, t, "user", f"long {t}") for c in (4000, 4001, 4103) for t in range(40 if c != 4103 else 33)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    return df.withColumns({"depth": F.lit("x"), "key": F.lit(1), "d1": F.lit(0), "length": F.lit("y")}).repartition(7)


@pytest.mark.parametrize("block", [256, 4])
def test_brute_force(table, block, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", 32)
    convs = ordered(conversations())
    assert collected(prefix_trie.trie(*prefix_trie.whole_conversations(table))) == brute(convs)
    assert collected(prefix_trie.trie(*prefix_trie.rebuilt(table))) == brute(rebuilt(convs))


def test_small(spark, table):
    assert collected(prefix_trie.trie(*prefix_trie.rebuilt(table.where("conv_id is null")))) == []
    # without its group's first conversation, one that loses all its turns ends at the root
    c = next(c for c in range(10, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    one = spark.createDataFrame([(c, 0, "user", "only")], "conv_id long, turn long, role string, text string")
    assert collected(prefix_trie.trie(*prefix_trie.rebuilt(one))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = collected(queries.QUERIES["op11_conversation_trie"](spark, path))
    assert got == brute(rebuilt(ordered(rows)))
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{path}/conversations.parquet'")
    names = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    assert sorted(db.sql(f"select {names} from ({queries.ORACLE_SQL['op11_conversation_trie']})").fetchall()) == got
