"""Hashes and similarities."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query keys that only track; all that begin with utm_ go, too.
TRACKING = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "ysclid")


def normalized_url(url: Column) -> Column:
    """(X21) Lower-case scheme and host, no user, default port, fragment, doubled or last slash, tracking or empty parameters; the rest sorted. Null without a host."""
    u = F.trim(url)
    u = F.when(F.lower(u).startswith("www."), F.concat(F.lit("http://"), u)).otherwise(u)
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    part = lambda k: F.regexp_extract(u, pattern, k)
    scheme = F.lower(F.coalesce(F.nullif(part(1), F.lit("")), F.lit("http")))
    host = F.lower(F.regexp_replace(part(2), "^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(part(3), "/{2,}", "/")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    pairs = F.transform(F.split(part(4), "&"), lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)).alias("k"), F.url_decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    key = lambda p: F.lower(p["k"])
    kept = F.array_sort(F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "") & ~key(p).startswith("utm_") & ~key(p).isin(*TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat_ws("=", F.url_encode(p["k"]), F.url_encode(p["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host != "", whole)


def text_hash(text: Column) -> Column:
    """(X22)"""
    return F.when(F.trim(text) != "", F.sha2(F.trim(text), 256))


def url_fingerprints(found: Column) -> Column:
    """(X23) One for each different link, in order; the first is the primary one."""
    return F.transform(F.array_distinct(F.filter(F.transform(found, normalized_url), lambda u: u.isNotNull())), lambda u: F.sha2(u, 256))


def _bits(tokens: list[str]) -> np.ndarray:
    digests = b"".join(hashlib.blake2b(t.encode(), digest_size=8).digest() for t in tokens)
    return np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)


@F.pandas_udf(T.LongType())
def simhash64(clean: pd.Series) -> pd.Series:
    """(X24) Signed 64-bit fingerprint of a cleaned text; token votes by count, BLAKE2b because readers of stored values expect it. Null without tokens.

    Each different token of a part of the batch is hashed once and votes are summed text by text.
    """
    out = pd.Series([None] * len(clean), dtype="Int64")
    for part, lists in _parts([t for t in x.split(" ") if t] if x else [] for x in clean):
        flat = list(chain.from_iterable(lists))
        number = {t: i for i, t in enumerate(dict.fromkeys(flat))}
        bits, sizes = _bits(list(number)), np.array([len(x) for x in lists])
        votes = _votes(bits, np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)), sizes)
        out.iloc[part] = np.packbits(2 * votes > sizes[:, None], axis=1).view(">i8").ravel().astype(np.int64)
    return out


def _votes(bits: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows of bits (0 or 1, 64 bytes a row) for each list; eight bytes are added at once, 255 rows fit a byte."""
    runs = -(-sizes // 255)
    before = np.cumsum(runs) - runs
    starts = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * (np.arange(runs.sum()) - np.repeat(before, runs))
    return np.add.reduceat(np.add.reduceat(bits.view(np.uint64)[rows], starts, axis=0).view(np.uint8), before, axis=0, dtype=np.int32)


def _parts(lists: Iterable[list[str]], most: int = 100_000) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Numbers of the lists that aren't empty and the lists, in parts of about so many tokens: only one part is in memory."""
    part, held, size = [], [], 0
    for k, tokens in enumerate(lists):
        if tokens:
            part.append(k)
            held.append(tokens)
            size += len(tokens)
        if size >= most:
            yield part, held
            part, held, size = [], [], 0
    if part:
        yield part, held


def hamming(a: Column, b: Column) -> Column:
    """(X25)"""
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column) -> Column:
    """(X26) 0 if a side is empty; blank members don't count."""
    plain = lambda x: F.filter(x, lambda v: v != "")
    both, any_ = F.size(F.array_intersect(plain(a), plain(b))), F.size(F.array_union(plain(a), plain(b)))
    return F.when((both > 0) & (any_ > 0), both / any_).otherwise(F.lit(0.0))


def quotes(text: Column, least: int = 20) -> Column:
    """Quoted passages of 20 to 240 characters, in lower case with single spaces."""
    found = F.regexp_extract_all(text, F.lit(r"[\"«“„]([^\"«»“”„]{20,240})[\"»”]"), F.lit(1))
    squeezed = F.transform(found, lambda q: F.trim(F.regexp_replace(F.lower(q), r"\s+", " ")))
    return F.filter(squeezed, lambda q: F.length(q) >= least)


def plain_text(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def quotes_match(text: Column, candidate: Column, least: int = 20) -> Column:
    """(X27) Whether the candidate holds one of the quotes."""
    return F.exists(quotes(text, least), lambda q: plain_text(candidate).contains(q))


def cosine(a: Column, b: Column) -> Column:
    """(X28) 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def theme_score(cos: Column, jac: Column, hours: Column) -> Column:
    """(X29)"""
    return 0.6 * cos + 0.25 * jac + 0.15 * F.coalesce(F.exp(-hours / 24), F.lit(1.0))


def softmax(logits: Column) -> Column:
    """(X30)"""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda x: x / total)


def label_of(probabilities: Column, labels: tuple[str, ...], least: float = 0.55) -> Column:
    """(M01, X30) The likeliest label, neutral below the threshold."""
    top = F.array_max(probabilities)
    return F.when(top < least, "neutral").otherwise(F.get(F.array(*map(F.lit, labels)), (F.array_position(probabilities, top) - 1).cast("int")))
