"""Operator 12: SentencePiece encoding and decoding with byte spans.

Method: offset-preserving encoding. A text is normalised by the longest prefixes that the
model's compiled character map knows; with each normalised byte goes the place in the
original that it stems from. The pieces are then projected over that alignment to spans of
original bytes. Pieces merge by score, leftmost first; characters without a piece fall back
to their bytes. Where no piece has white space after its first other character, a merge can't
cross the start of a word, so words are merged apart and remembered.

Defined results: null text encodes like the empty text (begin and end ids only); a null doc_id
stays null; repeated rows give repeated rows; an empty table gives no row; columns other than
doc_id and text are not read; a byte that is no UTF-8 becomes U+FFFD. A text is encoded as a
whole, in time n log n and memory linear in its longest word. Ids that are out of range make
decode raise. Models other than BPE, or with user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from newsflow.llm.merges import NO_RANK, PairMerges
from newsflow.llm.shared import arrow_session, text_rows
from newsflow.sources.testbed import spread

#: Fixed values of the model's file format.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE_MODEL = 2
#: A word with more characters than this merges through a heap instead of a matrix row, whose rounds would cost the square of its length.
LONGEST_ROW = 256
#: Distinct words that a worker remembers; it forgets all of them when there are more.
REMEMBERED = 400_000

codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a serialised protocol buffer."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """A compiled character map: a double array over byte strings and what each is replaced by."""

    def __init__(self, compiled: bytes):
        (size,) = struct.unpack_from("<I", compiled)
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
        self.replacements = compiled[4 + size :]
        self.starts = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in range(256) if self._step(self._child(0), b) is not None) + b"]") if self.units and any(self._step(self._child(0), b) is not None for b in range(256)) else None

    def _child(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """The end of the longest known prefix of text[at:], and its replacement."""
        found, base = None, self._child(0)
        for k in range(at, len(text)):
            node = self._step(base, text[k])
            if node is None:
                break
            base = self._child(node)
            if self.units[node] & 256:
                found = k + 1, self.units[base] & 0x7FFFFFFF
        if found is None:
            return None
        end, where = found
        return end, self.replacements[where : self.replacements.index(b"\0", where)]

    def edits(self, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(start, end, replacement) from left to right; what lies between stays."""
        at = 0
        for hit in self.starts.finditer(text) if self.starts else ():
            start = hit.start()
            if start >= at and text[start] & 0xC0 != 0x80 and (found := self.longest(text, start)):
                at = found[0]
                yield start, at, found[1]


class SentencePieces:
    """Encodes and decodes with a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = list(_fields(file.read()))
        pieces = [dict(_fields(v)) for k, v in model if k == 1]
        trainer, normaliser = (dict(x for k, v in model if k == n for x in _fields(v)) for n in (2, 3))
        kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != BPE_MODEL or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} is no BPE model of normal pieces")
        self.begin, self.end, self.unknown = trainer.get(41, 1), trainer.get(42, 2), kinds.index(UNKNOWN)
        self.fallback = bool(trainer.get(35, 0))
        self.prefix, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        self.map = CharacterMap(normaliser[2]) if normaliser.get(2) else None
        names = [p[1].decode() for p in pieces]
        self.ids = {name: k for k, name in enumerate(names) if kinds[k] == NORMAL}
        scores = [struct.unpack("<f", p.get(2, b"\0" * 4))[0] for p in pieces]
        self.names = sorted(self.ids, key=lambda name: -scores[self.ids[name]])
        held = [scores[self.ids[name]] for name in self.names]
        #: Pieces of equal score merge from left to right, whichever they are.
        self.levels = np.concatenate([[0], np.cumsum(np.diff(held) < 0)]) if held else np.zeros(0, np.int64)
        #: A symbol is the place of a piece by falling score; characters that are no piece come after all pieces.
        self.symbols = {name: k for k, name in enumerate(self.names)}
        self.of_symbol = np.array([self.ids[name] for name in self.names], np.int64)
        self.of_point = np.arange(0x110000, dtype=np.int32) + np.int32(len(self.names))
        for name, k in self.symbols.items():
            if len(name) == 1:
                self.of_point[ord(name)] = k
        self.merges = self._pairs()
        self.of_byte = np.zeros(256, np.int64)
        for k in range(len(names)):
            if kinds[k] == BYTE:
                self.of_byte[int(names[k][3:5], 16)] = k
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.length = np.array([1 if k == BYTE else len(n.encode()) for n, k in zip(names, kinds, strict=True)], np.int64)
        hidden = trainer.get(44, " ⁇ ".encode())
        self.surface = [bytes([int(n[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else hidden if k == UNKNOWN else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds, strict=True)]
        self.spaced = np.array([n.startswith(SPACE) and k == NORMAL for n, k in zip(names, kinds, strict=True)])
        crosses = any(SPACE in name.lstrip(SPACE) for name in self.ids)
        self.words = re.compile("(?s).+" if crosses else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, bytes] = {}

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the place in text it stems from."""
        parts, places, at, gone = [], [], 0, len(text)
        for start, end, new in self._edits(text):
            if not new:
                gone = min(gone, start)
            parts += [text[at:start], new]
            places += [np.arange(at, start), np.full(len(new), start)]
            at = end
        raw = np.frombuffer(b"".join([*parts, text[at:]]), np.uint8)
        place = np.concatenate([*places, np.arange(at, len(text)), [len(text)]])
        space = raw == 32
        first = 0
        if self.squeeze:
            solid = np.flatnonzero(~space)
            first = min(gone, place[solid[0]] if len(solid) else len(text))
            keep = ~(space & np.concatenate([[True], space[:-1]]))
            raw, space, place = raw[keep], space[keep], np.append(place[:-1][keep], place[-1])
        if first == len(text):
            return b"", place[-1:]
        if self.prefix:
            where = len(raw) if self.suffix else 0
            raw, space, place = np.insert(raw, where, 32), np.insert(space, where, True), np.insert(place, where, len(text) if self.suffix else first)
        normalised, blank = raw.tobytes(), b" "
        if self.escape:
            blank = SPACE.encode()
            normalised, place = normalised.replace(b" ", blank), np.append(np.repeat(place[:-1], np.where(space, 3, 1)), place[-1])
        if self.squeeze:
            while normalised.endswith(blank):
                normalised = normalised[: -len(blank)]
            place = place[: len(normalised) + 1]
        return normalised, place

    def _edits(self, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        found = self.map.edits(text) if self.map else iter(())
        try:
            text.decode()
        except UnicodeDecodeError:
            bad, at = [], 0
            while at < len(text):
                try:
                    text[at:].decode()
                    break
                except UnicodeDecodeError as error:
                    at += error.start
                    bad.append((at, at + 1, "�".encode()))
                    at += 1
            return iter(sorted([*found, *bad]))
        return found

    def _pairs(self) -> PairMerges:
        left, right, merged = [], [], []
        for name, symbol in self.symbols.items():
            for k in range(1, len(name)):
                a, b = self.symbols.get(name[:k], self._stranger(name[:k])), self.symbols.get(name[k:], self._stranger(name[k:]))
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(symbol)
        return PairMerges(left, right, merged, self.levels)

    def _stranger(self, name: str) -> int | None:
        """The symbol of a character that is no piece."""
        return len(self.symbols) + ord(name) if len(name) == 1 else None

    def _merge_matrix(self, words: list[str], width: int) -> Iterator[tuple[int, bytes]]:
        """(index, ids) of each word; all have at most width characters."""
        points, lens = np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.array([len(w) for w in words])
        for found, sizes, symbols in self.merges.merge(self.of_point[points], lens, width):
            if (strange := symbols >= len(self.symbols)).any() and self.fallback:
                points = symbols[strange] - len(self.symbols)
                size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
                raw = np.frombuffer("".join(map(chr, points.tolist())).encode(), np.uint8)
                each = np.ones(len(symbols), np.int64)
                each[strange] = size
                ids = np.repeat(self.of_symbol[np.where(strange, 0, symbols)], each)
                ids[np.repeat(strange, each)] = self.of_byte[raw]
                ends = np.cumsum(each)[np.cumsum(sizes) - 1]
            else:
                ids, ends = np.where(strange, self.unknown, self.of_symbol[np.where(strange, 0, symbols)]), np.cumsum(sizes)
            held, starts = ids.astype("<u4").tobytes(), np.concatenate([[0], ends[:-1]])
            for k, start, end in zip(found.tolist(), (starts * 4).tolist(), (ends * 4).tolist(), strict=True):
                yield k, held[start:end]

    def _merge_long(self, word: str) -> bytes:
        """The same merges for one long word: a heap of (level, place) over a linked list."""
        n = len(word)
        points = np.frombuffer(word.encode("utf-32-le"), "<u4")
        ids = self.of_point[points].tolist()
        names, symbols = self.names, self.symbols
        name = lambda x: names[x] if x < len(names) else chr(x - len(names))
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        first = self.merges.ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        level = self.levels.tolist()
        heap = [(level[r], k, ids[k], ids[k + 1], r) for k, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (r := symbols.get(name(ids[x]) + name(ids[y]))) is not None:
                    heapq.heappush(heap, (level[r], x, ids[x], ids[y], r))
        out: list[int] = []
        for x in ids:
            if x >= len(names):
                out += self.of_byte[np.frombuffer(chr(x - len(names)).encode(), np.uint8)].tolist() if self.fallback else [self.unknown]
            elif x >= 0:
                out.append(int(self.of_symbol[x]))
        return np.array(out, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        by_width: dict[int, list[str]] = {}
        for word in {w for w in words if w not in self.known}:
            if len(word) > LONGEST_ROW:
                self.known[word] = self._merge_long(word)
            else:
                by_width.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(word)
        for width, members in by_width.items():
            for k in range(0, len(members), step := max(1, (1 << 20) // width)):
                part = members[k : k + step]
                for index, ids in self._merge_matrix(part, width):
                    self.known[part[index]] = ids

    def pieces(self, normalised: list[str]) -> list[bytes]:
        """The ids of normalised texts, as little-endian 32-bit integers. The matrices take the distinct words of all of them."""
        cut = list(map(self.words.findall, normalised))
        self.learn(list(chain.from_iterable(cut)))
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]

    def encode_many(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text the ids with begin and end id, and where each piece begins and ends in it, in bytes.

        Of a character that falls back to bytes the last one has its span, those before it an
        empty span at its start. Unknown characters in a row are one unknown id.
        """
        normalised = [self.normalise(text) for text in texts]
        found = self.pieces([raw.decode() for raw, _ in normalised])
        return [self._projected(text, *n, np.frombuffer(ids, "<u4")) for text, n, ids in zip(texts, normalised, found, strict=True)]

    def _projected(self, text: bytes, normalised: bytes, place: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.fallback or self.unknown not in ids:
            ends = np.cumsum(self.length[ids])
            begins = ends - self.length[ids]
        else:
            ids, begins, ends = self._unknown_runs(normalised.decode(), ids)
        if self.is_byte[ids].any():
            raw = np.frombuffer(normalised, np.uint8)
            starts = np.append(raw & 0xC0 != 0x80, True)
            of_byte = self.is_byte[ids]
            first = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))
            begins, ends = np.where(of_byte, first[begins], begins), np.where(of_byte & ~starts[ends], first[begins], ends)
        return np.concatenate([[self.begin], ids, [self.end]]).astype("<u4"), np.concatenate([[0], place[begins], [len(text)]]), np.concatenate([[0], place[ends], [len(text)]])

    def _unknown_runs(self, normalised: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = {k: name for name, k in self.ids.items()}
        out, begins, ends, at, byte_at = [], [], [], 0, 0
        for k in ids.tolist():
            piece = normalised[at] if k == self.unknown else names[k]
            at, start, byte_at = at + len(piece), byte_at, byte_at + len(piece.encode())
            if k == self.unknown and out and out[-1] == k:
                ends[-1] = byte_at
            else:
                out.append(k), begins.append(start), ends.append(byte_at)
        return np.array(out, "<u4"), np.array(begins), np.array(ends)

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, in UTF-8. White space that normalising put at the start goes again."""
        if min(ids, default=0) < 0:
            raise IndexError("ids are not negative")
        parts = list(map(self.surface.__getitem__, ids))
        if self.prefix or self.squeeze:
            for k, part in enumerate(parts):
                if self.spaced[ids[k]]:
                    parts[k] = part[1:]
                    if parts[k] or not self.squeeze:
                        break
                elif part:
                    break
        joined = b"".join(parts)
        try:
            joined.decode()
        except UnicodeDecodeError:
            return joined.decode("utf-8", "one_by_one").encode()
        return joined


@cache
def codec(path: str) -> SentencePieces:
    """One codec for each worker process."""
    return SentencePieces(path)


ENCODED = "doc_id long, ids array<int>, begins array<int>, ends array<int>"


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = codec(path)
    for batch in batches:
        rows = model.encode_many([text or b"" for _, text in text_rows([batch])])
        lists = [pa.array([r[k].astype(np.int32) for r in rows], pa.list_(pa.int32())) for k in (0, 1, 2)]
        yield pa.record_batch([batch.column(0), *lists], names=["doc_id", "ids", "begins", "ends"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids, begins, ends: each piece's id and its span of bytes in text."""
    arrow_session(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_encoded, path=path), ENCODED)


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = codec(path)
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([model.decode(x or []).decode() for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids) -> doc_id, text. Null ids decode like none."""
    arrow_session(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, path=path), "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def _round_trip(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = codec(path)
    hexed = lambda data: hashlib.sha256(data).hexdigest()
    for batch in batches:
        rows = model.encode_many([text or b"" for _, text in text_rows([batch])])
        columns = [
            pa.array([len(ids) for ids, _, _ in rows], pa.int64()),
            pa.array([hexed(ids.tobytes()) for ids, _, _ in rows], pa.string()),
            pa.array([hexed(model.decode(ids.tolist())) for ids, _, _ in rows], pa.string()),
            pa.array([hexed(np.stack([begins, ends], 1).astype("<i8").tobytes()) for _, begins, ends in rows], pa.string()),
        ]
        yield pa.record_batch([batch.column(0), *columns], names=[c.split()[0] for c in DIGESTS.split(", ")])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each text in one pass and keep what identifies ids, spans and the decoded text."""
    arrow_session(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_round_trip, path=path), DIGESTS)


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, encoded with begin and end ids and decoded again."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return digests(docs, public_model())
