"""SentencePiece encoding over a table of distinct chunks, and decoding.

Where no piece of the model holds a whitespace marker after another sign, a merge never crosses from one marked word to
the next, and a text's pieces are those of its chunks, each a run of markers and the signs up to the next marker. So
the distinct chunks of all documents form a table, each is segmented once, and the ids are joined back by position:

1. documents are bundled into blocks of bounded size; a block asks for its distinct chunks, in one packed request for each
   of a fixed number of buckets, by a hash of the chunk;
2. requests are dealt by bucket, so that all requests for a chunk meet in one task. It segments what it has not seen yet
   and answers each request by the ids of its chunks in the order of the request;
3. answers go to the block's task, which lists the chunks once more in the same order and puts texts' ids together.

Only bundles, lists of distinct chunks and their ids are shuffled, packed and compressed, not the words' occurrences.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count
from struct import pack, unpack

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from palimpsest.llm.common import small_batches

MARK = "▁"
#: Bytes of text in a block of documents, beside the batch that fills it.
BLOCK_BYTES = 16 << 20
#: Buckets for each partition of a shuffle, and at most.
BUCKETS, MAX_BUCKETS = 4, 1024
#: Chunks that a task remembers with their ids before it begins anew.
MEMORY = 1_000_000
#: From this many signs on, a chunk's merges are kept in a queue; below, the list is searched for the next one.
LONG = 48
#: Compression of the bundled documents, which are most of what is shuffled.
LEVEL = 6
UNKNOWN_TEXT = " ⁇ "

_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """A model file's pieces. A model is an error unless it merges by scores (BPE), falls back on bytes, leaves the text
    as it is but for one marker put before it, and has no piece with a marker after another sign."""

    def __init__(self, data: bytes):
        pieces, trainer, normal = [], {}, {}
        for key, value in _fields(data):
            if key == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, _NORMAL)))
            elif key == 2:
                trainer = dict(_fields(value))
            elif key == 3:
                normal = dict(_fields(value))
        kinds = {k for *_, k in pieces}
        plain = not normal.get(2) and normal.get(3, 1) == 1 and normal.get(4, 1) == 0 and normal.get(5, 1) == 1 and not trainer.get(24)
        if trainer.get(3, 1) != 2 or not trainer.get(35) or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or not plain:
            raise ValueError("not a plain byte-fallback BPE model")
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == _NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses a whitespace marker")
        # Merges compare scores, the highest first; equal scores go by place.
        order = {s: n for n, s in enumerate(sorted({s for _, s, k in pieces if k == _NORMAL}, reverse=True))}
        self.rank = {p: order[s] for p, s, k in pieces if k == _NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == _BYTE}
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.kind = [k for *_, k in pieces]
        self.controls = {i for i, k in enumerate(self.kind) if k == _CONTROL}
        surface = {_NORMAL: lambda p: p.replace(MARK, " ").encode(), _BYTE: lambda p: bytes([int(p[3:5], 16)]), _UNKNOWN: lambda p: UNKNOWN_TEXT.encode(), _CONTROL: lambda p: b""}
        self.surface = [surface[k](p) for p, _, k in pieces]
        # The pieces' bytes one after another, and where each one's are.
        self.letters = np.frombuffer(b"".join(self.surface), dtype=np.uint8)
        self.lengths = np.array([len(x) for x in self.surface], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def _merged(self, parts: list[str]) -> list[str]:
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        rank, n = self.rank.get, len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        queue: list[tuple[int, int, int]] = []

        def offer(at: int) -> None:
            found = rank(parts[at] + parts[after[at]])
            if found is not None:
                heapq.heappush(queue, (found, at, len(parts[at]) + len(parts[after[at]])))

        for at in range(n - 1):
            offer(at)
        while queue:
            found, at, size = heapq.heappop(queue)
            right = after[at]
            # A pair is out of date if one side has grown or gone since.
            if not parts[at] or right >= n or len(parts[at]) + len(parts[right]) != size or rank(parts[at] + parts[right]) != found:
                continue
            parts[at] += parts[right]
            parts[right] = ""
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
                offer(at)
            if before[at] >= 0:
                offer(before[at])
        return [p for p in parts if p]

    def segment(self, chunk: str) -> list[int]:
        """The ids of a chunk; signs without a piece become bytes."""
        out: list[int] = []
        for piece in self._merged([*chunk]) if len(chunk) < LONG else self._merged_long([*chunk]):
            own = self.ids.get(piece)
            out += [own] if own is not None else [self.bytes[b] for b in piece.encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's text of any ids: control pieces are empty, the first marker goes, bytes that are no UTF-8 become
        replacement signs, one for each."""
        surface, kind = self.surface, self.kind
        first, last = 0, len(ids)
        while first < last and kind[ids[first]] == _CONTROL:
            first += 1
        while first < last and kind[ids[last - 1]] == _CONTROL:
            last -= 1
        own = ids[first:last]
        body = b"".join([surface[i] for i in own])
        blank = bool(own) and kind[own[0]] == _NORMAL and body[:1] == b" "
        try:
            if not self.controls.intersection(own):
                return body.decode()[blank:]
        except UnicodeDecodeError:
            pass
        out, run = [], bytearray()
        for i in [*own, None]:
            if i is not None and kind[i] == _BYTE:
                run += surface[i]
                continue
            while run:  # bytes are one run up to the next other piece
                size = 1 if run[0] < 0x80 else 2 if run[0] < 0xE0 else 3 if run[0] < 0xF0 else 4
                try:
                    out.append(run[:size].decode())
                except UnicodeDecodeError:
                    size = 1
                    out.append("\N{REPLACEMENT CHARACTER}")
                del run[:size]
            if i is not None:
                out.append(surface[i].decode())
        return "".join(out)[blank:]


def chunks(text: str) -> list[str]:
    """The marked chunks of a text, in order, each without its first marker."""
    if not text:
        return []
    marked = text.replace(" ", MARK)
    if MARK + MARK not in marked and marked[0] != MARK:
        return marked.split(MARK) if marked[-1] != MARK else [*marked[:-1].split(MARK), ""]
    return [c[1:] for c in re.findall(f"{MARK}+[^{MARK}]*", MARK + marked)]


def _requests(words: list[str], buckets: int) -> tuple[list[tuple[int, list[str]]], np.ndarray]:
    """(bucket, its chunks) of distinct chunks, empty buckets left out, and the chunks' places, bucket after bucket."""
    if not words:
        return [], np.zeros(0, dtype=np.int64)
    held = np.array(words, dtype=object)
    bucket = (pd.util.hash_array(held, categorize=False) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = np.split(held[order], cuts)
    return [(int(b), w.tolist()) for b, w in zip(bucket[order[np.append(0, cuts)]], parts, strict=True)], order


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs one after another."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def _pack(words: list[str]) -> bytes:
    """Chunks hold no markers but leading ones, so a blank can end each."""
    return zstandard.compress(" ".join(words).encode(), 3)


def _unpack(data: bytes) -> list[str]:
    return zstandard.decompress(data).decode().split(" ")


def _answer(ids: list[bytes]) -> bytes:
    """Sizes of the chunks' id lists, then the ids, as 32-bit integers."""
    sizes = np.array([len(x) // 4 for x in ids], dtype="<u4")
    return zstandard.compress(len(ids).to_bytes(4, "little") + sizes.tobytes() + b"".join(ids), 3)


def _answered(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the chunks' id lists, ids)."""
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, "<u4", n, 4).astype(np.int64), np.frombuffer(raw, "<u4", -1, 4 + 4 * n)


def _digest(words: list[str]) -> int:
    return xxhash.xxh32_intdigest("\n".join(words).encode())


class Segmenter:
    """Segments chunks and remembers them."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, words: list[str]) -> list[bytes]:
        known, segment = self.known, self.model.segment
        out = []
        for word in words:
            ids = known.get(word)
            if ids is None:
                if len(known) >= MEMORY:
                    known.clear()
                own = segment(MARK + word)
                ids = known[word] = pack(f"<{len(own)}I", *own)
            out.append(ids)
        return out


def _blocks(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[tuple[int, list[pa.RecordBatch], list[str]]]:
    """(number, batches, texts) of the blocks of a partition, whose own number is the last column."""
    number, held, texts, size = None, [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if number is None:
            number = batch.column(batch.num_columns - 1)[0].as_py() << 32
        held.append(batch)
        own = batch.column(text)
        texts += [t or "" for t in own.to_pylist()]
        size += own.nbytes
        if size >= most:
            yield number, held, texts
            number, held, texts, size = number + 1, [], [], 0
    if held:
        yield number, held, texts


_PARCEL = "block long, bucket int, words long, payload binary"
_ARROW_PARCEL = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.int64()), ("payload", pa.binary())])


def _parcels(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_PARCEL, strict=True)], schema=_ARROW_PARCEL)


def _sent(docs: DataFrame, place: int, model_path: str, block_bytes: int) -> DataFrame:
    """Each block's answers (block, bucket, digest of the chunks asked for, payload) and its documents (bucket -1).

    place: the text's column. A block has one number in both readings: that of the partition of ``docs``, which is taken
    before the two are put together, and its place in it."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(open(model_path, "rb").read())
    n_buckets = _buckets(docs)
    part = "_" + "_".join(docs.columns)
    numbered = docs.select("*", F.spark_partition_id().alias(part))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts in _blocks(batches, place, block_bytes):
            words = [*dict.fromkeys(chain.from_iterable(map(chunks, texts)))]
            own = [(number, b, _digest(w), _pack(w)) for b, w in _requests(words, n_buckets)[0]]
            yield _parcels(own)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segmenter(Model(held.value))
        for batch in batches:
            rows = [(r["block"], r["bucket"], r["words"], _answer(segment(_unpack(r["payload"])))) for r in batch.to_pylist()]
            yield _parcels(rows)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own, _ in _blocks(batches, place, block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as stream:
                for batch in own:
                    stream.write_batch(batch)
            yield _parcels([(number, -1, 0, sink.getvalue().to_pybytes())])

    asked = numbered.mapInArrow(ask, _PARCEL).repartition("bucket")
    return asked.mapInArrow(answer, asked.schema).unionAll(numbered.mapInArrow(bundle, asked.schema))


def _buckets(docs: DataFrame) -> int:
    return min(MAX_BUCKETS, BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_pieces(docs: DataFrame, model_path: str, text: str = "text", out: str = "pieces", keep_ids: bool = True, keep_text: bool = True,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds a struct: n_tokens, ids_sha256, decoded_sha256, and ids unless keep_ids is off; all ids count, begin and end too.

    The model's file is read once, on the driver, and broadcast: a vocabulary's size is fixed. Null and empty texts have
    the begin and end ids only. Repeated rows get equal results, an empty table stays empty, texts are read whole, and
    chunks may have any length. A column named as ``out`` is replaced; all others stay, but the text with keep_text off.
    A chunk is segmented once in a task that knows at most ``MEMORY`` of them at a time. If a block that is read again
    after a loss lists other chunks than those it had asked for, it segments them itself.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(open(model_path, "rb").read())
    small_batches(spark)
    if not isinstance(docs.schema[text].dataType, StringType):
        raise TypeError(f"{text} is not a column of strings")
    docs = docs.drop(*(c for c in docs.columns if c == out and c != text))
    place, n_buckets = docs.columns.index(text), _buckets(docs)
    kept = [c for k, c in enumerate(docs.columns) if k != place or keep_text and out != text]
    kind = f"n_tokens long, ids_sha256 string, decoded_sha256 string{', ids array<int>' * keep_ids}"

    schema = StructType([docs.schema[c] for c in kept]).add(out, spark.createDataFrame([], kind).schema)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(held.value)
        segment, now, answers = Segmenter(model), None, {}
        for parcel in chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches):
            block, bucket, words, payload = parcel
            if block != now:
                now, answers = block, {}
            if bucket >= 0:  # a block's documents come after its answers
                answers[bucket] = words, payload
                continue
            own = pa.ipc.open_stream(payload).read_all()
            index = defaultdict(count().__next__)  # a chunk gets its number when it is first seen
            codes = [np.array([*map(index.__getitem__, chunks(t or ""))], dtype=np.int32) for t in own.column(place).to_pylist()]
            code = np.concatenate(codes)
            requests, order = _requests([*index], n_buckets)
            sizes, ids = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype="<u4")]
            for b, wanted in requests:
                digest, held_ids = answers.get(b, (None, None))
                n, found = _answered(held_ids if digest == _digest(wanted) else _answer(segment(wanted)))
                sizes.append(n)
                ids.append(found)
            # Of every chunk, by its number in the block, where its ids are.
            size, start, flat = np.zeros(len(index), dtype=np.int64), np.zeros(len(index), dtype=np.int64), np.concatenate(ids)
            size[order] = np.concatenate(sizes)
            start[order] = np.cumsum(size[order]) - size[order]
            chunks_of = np.cumsum([0, *map(len, codes)])
            at = 0
            for batch in own.to_batches():
                inside = code[chunks_of[at] : chunks_of[at + batch.num_rows]]
                token = flat[_spread(start[inside], size[inside])]
                ends = np.cumsum(np.append(0, size[inside]))[chunks_of[at : at + batch.num_rows + 1] - chunks_of[at]]
                yield _coded(batch, token, ends.tolist(), model)
                at += batch.num_rows

    def _coded(batch: pa.RecordBatch, token: np.ndarray, ends: list[int], model: Model) -> pa.RecordBatch:
        """token: the ids of the batch's texts one after another; ends: where each text's begin and end."""
        length = model.lengths[token]
        spelled = model.letters[_spread(model.offsets[token], length)].tobytes()
        cut = np.append(0, np.cumsum(length))[ends].tolist()
        coded = [np.concatenate([[model.begin], token[a:b], [model.end]]).astype("<u4") for a, b in zip(ends, ends[1:])]
        # Every text's first piece begins with a marker, which is no part of the text.
        decoded = [spelled[a + 1 : b] for a, b in zip(cut, cut[1:])]
        columns = {
            "n_tokens": pa.array([len(x) for x in coded], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
        }
        if keep_ids:
            columns["ids"] = pa.array([x.astype(np.int32) for x in coded], pa.list_(pa.int32()))
        made = pa.StructArray.from_arrays([*columns.values()], names=[*columns])
        arrays = [a for k, a in enumerate(batch.columns) if batch.schema.names[k] in kept]
        return pa.RecordBatch.from_arrays([*arrays, made], names=[*kept, out])

    # Of a block, answers in any order and then the documents.
    sent = _sent(docs, place, model_path, block_bytes).repartition("block").sortWithinPartitions("block", F.col("bucket").desc())
    return sent.mapInArrow(assemble, schema)


def decode_ids(rows: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for; null ids give null, an id outside the vocabulary fails."""
    held = rows.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())

    @F.arrow_udf("string")
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(held.value)
        for batch in batches:
            yield pa.array([None if x is None else model.decode(x) for x in batch.to_pylist()], pa.string())

    return rows.withColumn(out, column(F.col(ids)))
