"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

The distinct pre-tokens of a batch of texts form a small corpus of words, each a chain of byte tokens. An inverted
index leads from each mergeable pair, by rank, to the places where it stands. Ranks are replayed from the lowest on:
all places of a pair are merged, and only the pairs with the touched neighbours are entered anew. Every word comes out
as the library would encode it alone. Texts are then put together from their words.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import small_batches, whole_text

#: Words, with their ids, that a worker remembers between batches.
MEMORY = 400_000
#: Words that are replayed together: few enough that their chains stay in a processor's cache.
CORPUS = 4096
#: Bits of an id in a pair's number.
SHIFT = 32


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file of base64 and rank lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


# Patterns of the regex library that the faster standard one can state for texts without characters on which the two
# differ: separators that only one takes for blanks, numbers that are no digits, and everything from U+0180 on.
_PLAIN = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""":
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""",
}
_NOT_PLAIN = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0180-\U0010ffff]").search


class Merges:
    """The ranks as numbers: which pairs of ids merge, and to which id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << SHIFT | b] = rank
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)


def replay(words: list[bytes], merges: Merges) -> list[list[int]]:
    """The ids of each word.

    Within a word the pair of lowest rank merges first, of equal pairs the leftmost. Places are numbered through all
    words with a gap after each, and a merged token lives at its first byte's place.
    """
    size = np.array([len(w) for w in words])
    tail = np.cumsum(size + 1) - 1
    flat = merges.byte[np.frombuffer(b"\0".join([*words, b""]), dtype=np.uint8)]
    flat[tail] = -1
    key = np.where((flat[:-1] >= 0) & (flat[1:] >= 0), flat[:-1] << SHIFT | flat[1:], -1)
    found = np.minimum(np.searchsorted(merges.keys, key), len(merges.keys) - 1)
    first = np.append(np.where(merges.keys[found] == key, merges.values[found], -1), -1)
    # The inverted index: of each rank, the places where its pair stands.
    at = np.flatnonzero(first >= 0)
    at = at[np.argsort(first[at], kind="stable")]
    edges = np.flatnonzero(np.diff(first[at])) + 1
    places = {int(first[own[0]]): own.tolist() for own in np.split(at, edges) if len(own)}
    token, pair, n = flat.tolist(), first.tolist(), len(flat)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = sorted(places)
    get, push, pop = merges.pairs.get, heapq.heappush, heapq.heappop
    while queue:
        rank = pop(queue)
        own = places.pop(rank)
        own.sort()
        for k, at in enumerate(own):
            if pair[at] != rank:
                continue
            right = after[at]
            end = after[right]
            token[at], pair[right] = rank, -1
            after[at], before[end] = end, at
            lower = False
            left, next_ = before[at], token[end]
            r = get(rank << SHIFT | next_, -1) if next_ >= 0 else -1
            pair[at] = r
            if r >= 0:
                if r in places:
                    places[r].append(at)
                else:
                    places[r] = [at]
                    push(queue, r)
                lower = r <= rank
            if left >= 0 and token[left] >= 0:
                r = get(token[left] << SHIFT | rank, -1)
                pair[left] = r
                if r >= 0:
                    if r in places:
                        places[r].append(left)
                    else:
                        places[r] = [left]
                        push(queue, r)
                    lower |= r <= rank
            # A pair that ranks lower comes before the places that are left.
            if lower and k + 1 < len(own):
                if rank in places:
                    places[rank] += own[k + 1 :]
                else:
                    places[rank] = own[k + 1 :]
                    push(queue, rank)
                break
    out = []
    for head in (tail - size).tolist():
        ids, at = [], head
        while token[at] >= 0:
            ids.append(token[at])
            at = after[at]
        out.append(ids)
    return out


class Codec:
    """Encodes and decodes texts; remembers words between batches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.merges = Merges(ranks)
        self.tokens = {r: t for t, r in ranks.items()}
        self.any_text = regex.compile(pattern).findall
        self.plain = re.compile(_PLAIN.get(pattern, pattern)).findall if pattern in _PLAIN else None
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.plain(t) if self.plain and not _NOT_PLAIN(t) else self.any_text(t) for t in texts]
        if len(self.known) > MEMORY:
            self.known = {}
        known = self.known
        new = list(dict.fromkeys(w for w in itertools.chain.from_iterable(parts) if w not in known))
        if new:
            for at in range(0, len(new), CORPUS):
                own = new[at : at + CORPUS]
                for w, ids in zip(own, replay([w.encode("utf-8") for w in own], self.merges), strict=True):
                    known[w] = pack(f"<{len(ids)}I", *ids)
        return [np.frombuffer(b"".join([known[w] for w in own]), dtype="<u4") for own in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def with_tokens(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "tokens", keep_ids: bool = True) -> DataFrame:
    """Adds a struct: n_tokens, ids_sha256, decoded_sha256, and ids unless keep_ids is off.

    The ranks' file is read once, on the driver, and broadcast: a vocabulary's size is fixed. Null and empty texts have
    no ids. Repeated rows get equal results, an empty table stays empty, and texts are read whole. A column named as
    ``out`` is replaced, all others stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    small_batches(docs.sparkSession)
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    @F.pandas_udf(kind)
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(held.value, pattern)
        for texts in batches:
            rows = []
            for ids in codec.encode(list(texts)):
                row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())
                rows.append((*row, ids.astype(np.int32)) if keep_ids else row)
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 3 + keep_ids])

    return docs.withColumn(out, column(whole_text(text)))


def decode_ids(rows: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; null ids give null, an id outside the vocabulary fails."""
    held = rows.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    @F.pandas_udf("binary")
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = {r: t for t, r in held.value.items()}
        for batch in batches:
            yield pd.Series([None if x is None else b"".join([tokens[i] for i in x]) for x in batch])

    return rows.withColumn(out, column(F.col(ids)))
