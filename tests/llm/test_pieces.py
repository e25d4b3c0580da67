"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from palimpsest.llm import pieces, queries


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


@pytest.fixture(scope="module")
def model():
    with open(queries.piece_model(), "rb") as data:
        return pieces.Model(data.read())


def _expected(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(library.decode(ids).encode())


def test_documents_match_the_library(spark, sf, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {r.doc_id: _expected(library, r.text) for r in docs}


def test_any_text_and_any_ids_match_the_library(library, model):
    rnd = random.Random(1)
    signs = "abcdeTh  \n\t▁é漢😀ا0123.,-\x00　�"
    odd = lambda: chr(rnd.choice([rnd.randrange(1, 0xD800), rnd.randrange(0xE000, 0x110000)]))
    for n in [0, 1, 2, 3, 10, 40, 120] * 300:
        text = "".join(rnd.choice(signs) if rnd.random() < 0.8 else odd() for _ in range(n))
        ids = [model.begin, *(i for c in pieces.chunks(text) for i in model.segment(pieces.MARK + c)), model.end]
        assert ids == library.encode(text, add_bos=True, add_eos=True) and model.decode(ids) == library.decode(ids)
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), 28705, 0, 1, 2]) for _ in range(rnd.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)


def test_both_ways_of_merging_agree(model):
    rnd = random.Random(4)
    for _ in range(300):
        chunk = "▁" * rnd.randint(0, 20) + "".join(rnd.choices("aeinst", k=rnd.randint(1, 90)))
        assert model._merged([*chunk]) == model._merged_long([*chunk])


def test_edge_rows_blocks_and_clashing_columns(spark, library):
    texts = [None, "", " ", "▁", "same words here", "same words here", "漢 " * 20_000, "x" * 100_000, *(f"a  b{k} <s>" for k in range(40))]
    rows = [(k if k % 7 else None, t, k, "p", [1.5]) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, payload string, bucket array<double>")
    # Nearly every document is a block, or all of them are one.
    for bound in (1, 1 << 20):
        got = pieces.with_pieces(df, queries.piece_model(), block_bytes=bound)
        assert got.columns == [*df.columns, "pieces"]
        found = sorted(got.collect(), key=lambda r: r.block)
        assert [tuple(r)[:5] for r in found] == rows and [tuple(r.pieces)[:3] for r in found] == [_expected(library, t) for t in texts]
        assert all(r.pieces.ids == library.encode(r.text or "", add_bos=True, add_eos=True) for r in found)
    back = pieces.decode_ids(got.select("block", "pieces.ids"), queries.piece_model()).orderBy("block")
    assert [r.decoded for r in back.collect()] == [library.decode(library.encode(t or "")) for t in texts]
    again = pieces.with_pieces(got, queries.piece_model(), keep_ids=False)
    assert again.columns == got.columns and again.select("pieces.*").columns == ["n_tokens", "ids_sha256", "decoded_sha256"]
    replaced = pieces.with_pieces(df, queries.piece_model(), out="text")
    assert replaced.columns == ["doc_id", "block", "payload", "bucket", "text"]


def test_empty_tables_and_other_kinds(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.with_pieces(none, queries.piece_model()).count() == 0
    with pytest.raises(TypeError):
        pieces.with_pieces(none.select(F.col("doc_id").alias("text")), queries.piece_model())
    with pytest.raises(ValueError, match="not a plain"):
        pieces.Model(b"")


def test_a_block_that_asked_for_other_chunks_segments_its_own(spark, library):
    """Rows that change between two readings, as after a loss: the ids still belong to the text that is returned."""
    df = spark.range(0, 60, 1, 3).select(F.concat(F.lit("word "), (F.rand() * 1e6).cast("long").cast("string")).alias("text"))
    for r in pieces.with_pieces(df, queries.piece_model()).collect():
        assert r.pieces.ids == library.encode(r.text, add_bos=True, add_eos=True)


@pytest.mark.parametrize("partitions", [1, 5])
def test_answers_reach_the_blocks_that_asked(spark, sf, partitions):
    """Every block finds answers to all its own chunks beside its documents, so that none is segmented a second time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(partitions).cache()
    parcels = pieces._sent(docs, 1, queries.piece_model(), 1 << 16).collect()
    docs.unpersist()
    answers = {(r.block, r.bucket): r.words for r in parcels if r.bucket >= 0}
    blocks = [r for r in parcels if r.bucket < 0]
    assert len(blocks) == len({r.block for r in blocks}) >= partitions
    wanted = {}
    for r in blocks:
        texts = pieces.pa.ipc.open_stream(r.payload).read_all().column(1).to_pylist()
        words = [*dict.fromkeys(c for t in texts for c in pieces.chunks(t or ""))]
        wanted |= {(r.block, b): pieces._digest(w) for b, w in pieces._requests(words, pieces._buckets(docs))[0]}
    assert wanted == answers
