"""Operator 12 against the sentencepiece library, with models of several kinds and awkward rows."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from newsflow.llm import queries, sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", " ", "▁", "\n", "\t", "　", "é", "日", "😀", "ﬁ", "\xa0", "<s>", "th", "e", "\x00", "A", "  "]


def texts(n=3000, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(30))) for _ in range(n)]
    return [*made, "", " ", "a" * 3000, " " * 100, "é日b" * 500, "the cat sat. " * 2000]


def number(value):
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def message(fields):
    return b"".join(number(k << 3 | 2) + number(len(v)) + v if isinstance(v, bytes) else number(k << 3) + number(v) for k, v in fields)


def double_array(entries):
    """A compiled character map by the first base that fits."""
    units, blob, taken = [0] * 65536, b"", {0}

    def place(node, known, label_bits):
        nonlocal blob
        labels = sorted({k[0] if k else 0 for k in known})
        base = next(b for b in range(1, 60000) if not any(b ^ x in taken for x in labels))
        taken.update(base ^ x for x in labels)
        units[node] = label_bits | (256 if b"" in known else 0) | (base ^ node) << 10
        if b"" in known:
            units[base] = 1 << 31 | len(blob)
            blob += known[b""] + b"\0"
        for x in labels:
            if rest := {k[1:]: v for k, v in known.items() if k and k[0] == x}:
                place(base ^ x, rest, x)

    place(0, entries, 0)
    data = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(data)) + data + blob


def model_file(folder, prefix=1, squeeze=0, compiled=b"", fallback=1):
    """The public model under another normaliser."""
    with open(PATH, "rb") as file:
        fields = list(sentence_pieces._fields(file.read()))
    trainer = [(k, fallback if k == 35 else v) for part, v in fields if part == 2 for k, v in sentence_pieces._fields(v) if k not in (10, 15, 51)]
    # kinds of pieces: byte pieces are allowed under byte fallback only
    pieces = [v if fallback or dict(sentence_pieces._fields(v)).get(3) != 6 else message([(1, dict(sentence_pieces._fields(v))[1] + b"!")]) + b"\x15\0\0\0\0" for k, v in fields if k == 1]
    path = str(folder / f"m{prefix}{squeeze}{len(compiled)}{fallback}.model")
    with open(path, "wb") as file:
        file.write(message([*((1, p) for p in pieces), (2, message(trainer)), (3, message([(1, b"own"), (2, compiled), (3, prefix), (4, squeeze), (5, 1)]))]))
    return path


MAP = double_array({"ﬁ".encode(): b"fi", "A".encode(): b"a", "Aé".encode(): "Ä b".encode(), "　".encode(): b" ", "\t".encode(): b" ", "日".encode(): b"", "th".encode(): "the ".encode()})


@pytest.mark.parametrize(("prefix", "squeeze", "compiled", "fallback"), [(1, 0, b"", 1), (0, 0, b"", 1), (1, 1, b"", 1), (1, 0, MAP, 1), (1, 1, MAP, 1), (0, 1, MAP, 1), (1, 0, b"", 0)])
def test_equals_the_library(tmp_path, prefix, squeeze, compiled, fallback):
    path = model_file(tmp_path, prefix, squeeze, compiled, fallback)
    own, library = sentence_pieces.SentencePieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    given = texts()
    for text, (ids, begins, ends) in zip(given, own.encode_many([t.encode() for t in given]), strict=True):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text
        assert own.decode(ids.tolist()).decode() == library.decode(ids.tolist()), text
        proto = library.encode(text, return_type="proto")
        assert list(zip(begins[1:-1].tolist(), ends[1:-1].tolist(), strict=True)) == [(p.begin, p.end) for p in proto.pieces], text
    rng = random.Random(2)
    for _ in range(3000):
        ids = rng.choices([0, 1, 2, 3, 200, 230, 259, 28705, 302, 1000, 5000], k=rng.randrange(8))
        assert own.decode(ids).decode() == library.decode(ids), ids


def test_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [*enumerate(texts(200)), (7, "again"), (7, "again"), (None, "no id"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("begins", F.lit(1)).repartition(5)
    got = sentence_pieces.encode(docs, PATH)
    want = sorted((-1 if k is None else k, library.encode(t or "", add_bos=True, add_eos=True)) for k, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in got.collect()) == want
    back = sentence_pieces.decode(got, PATH).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in back) == sorted((k, library.decode(ids)) for k, ids in want)
    assert sentence_pieces.encode(docs.where("false"), PATH).count() == 0


def test_spans_tile_the_text():
    own = sentence_pieces.codec(PATH)
    for text in texts(300):
        _, begins, ends = own.encode_many([text.encode()])[0]
        assert begins[1:].tolist() == [0, *ends[1:-1].tolist()] or not len(text.encode())
        assert ends[-1] == len(text.encode())


def test_invalid_bytes_and_ids():
    own = sentence_pieces.codec(PATH)
    ids, begins, ends = own.encode_many([b"a\xff\xfe b"])[0]
    assert own.decode(ids.tolist()).decode() == "a�� b" and ends[-1] == 5
    for bad in ([40000], [-1]):
        with pytest.raises(IndexError):
            own.decode(bad)


def test_query(spark):
    library, sf = sentencepiece.SentencePieceProcessor(model_file=PATH), "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op12_sentence_pieces"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        hexed = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert hexed == (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256)
