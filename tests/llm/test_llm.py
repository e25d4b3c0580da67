"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontam, html_extract, langid, pii, quality, queries, sharding, simhash, topk, toxicity

DOC = "doc_id long, text string, extra int, shard string"
EDGE = [
    (1, None, 1, "a"), (2, "", 1, "a"), (3, " \n", None, None), (4, "one", 1, "a"), (5, "One", 1, "a"), (5, "One", 1, "a"),
    (None, "a b c d e f", 1, "a"), (7, "a b c d e f", 2, "b"), (8, "x" * 200_000, 1, "a"), (9, "a b c d e f", 1, "c"),
    (10, "mail me: a.b@c.de or +1 (555) 123-4567", 1, "z"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOC)


def _union(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _slow_fingerprint(spark, texts):
    """By Spark's own xxhash64 and plain counting."""
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in low]
    grams = [[" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else [] for w in words]
    rows = spark.createDataFrame(list(enumerate(grams)), "i int, g array<string>")
    hashed = {r.i: r.h for r in rows.select("i", F.transform("g", lambda x: F.xxhash64(x)).alias("h")).collect()}
    out = []
    for i in range(len(texts)):
        h = [x % 2**64 for x in hashed[i]]
        out.append(sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def test_simhash_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = _slow_fingerprint(spark, [r.text for r in rows])
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = _union(len(rows), links)
    least = defaultdict(lambda: 10**18)
    for k, r in zip(root, rows):
        least[k] = min(least[k], r.doc_id)
    want = {(r.doc_id, f"{p:016x}", least[k]) for r, p, k in zip(rows, prints, root)}
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("cap", [4, 1 << 14])
def test_simhash_links_dense_and_hot_groups(spark, cap):
    rng = np.random.default_rng(5)
    heads = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = {int(h) for h in heads}
    for h in heads:
        for _ in range(40):
            x = int(h)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = _union(len(prints), links)
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    known = simhash.components(simhash.link_forest(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, cap))
    top = {r.node: r.root for r in known.collect()}
    got = [top.get(x, x) for x in signed]
    same = lambda roots: {frozenset(i for i, r in enumerate(roots) if r == k) for k in set(roots)}
    assert same(got) == same(want)


def test_simhash_edge_rows(spark, edge):
    rows = simhash.near_duplicate_classes(edge).collect()
    assert len(rows) == len(EDGE)
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in rows if r.doc_id in (None, 7, 9)} == {7}
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {"0" * 16}
    kept = simhash.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 7, 8, 10, None} <= set(ids) and not {2, 3, 9} & set(ids)
    assert simhash.near_duplicate_classes(edge.limit(0)).count() == 0


def test_simhash_drops_rows_not_ids(spark):
    one, other, third = (" ".join(f"{w}{k}" for k in range(40)) for w in ("red", "green", "blue"))
    rows = [(1, one), (5, one), (5, other), (6, other), (7, third), (7, third), (None, "no id here"), (None, "no id here"), (None, "no id here")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, one), (5, other), (7, third), (0, "no id here")])


def _slow_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = re.sub(r"\D", "", m[0])
        if 14 <= len(g) <= 19 and pii.luhn(g):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return pii.in_order(out)


def test_pii_base_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    parts = ["1", "23", "255", "300", ".", "-", " ", "+", "@", "a", "b.c", "(", "4111111111111111", "x@y.z", "1.2.3.4", "é"]
    for _ in range(5000):
        t = "".join(rng.choice(parts, rng.integers(0, 18)))
        assert pii.base_spans(t) == _slow_base(t)


def test_pii_query_matches_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op2_pii(spark, sf).collect():
        base = _slow_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert {pii.written([b]) for b in base} <= set(r.spans.split(","))


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("é jane at example dot com", "email", "jane at example dot com"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("the аlice@exаmple.com", "email", "аlice@exаmple.com"),
        ("ip one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"),
        ("plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("4111 1111 one one one one 1111", "card", "4111 1111 one one one one 1111"),
    ],
)
def test_pii_disguises_map_back(text, kind, span):
    base, every = pii.detect(text)
    assert [(k, text[s:e]) for k, s, e in every if (k, s, e) not in base] == [(kind, span)]


@pytest.mark.parametrize("text", ["version 1 dot 2 dot 3", "two plus 2 is 4", "plus 12 more", "one, two, three"])
def test_pii_leaves_plain_numbers_alone(text):
    assert pii.detect(text) == ([], [])


_CARD_NAMES = "four" + " one" * 15


@pytest.mark.parametrize(
    ("text", "kind", "spans"),
    [
        *[(f"host {x} up", "ip", [x]) for x in (
            "192 dot 168 dot 1 dot 1", "192[.]168[.]1[.]1", "192.168.1[.]1", "192 (dot) 168 (dot) 1 (dot) 1", "10 dot 0 dot 0 dot one",
            "one nine two [dot] one six eight [dot] one [dot] one", "192.168.1.one",
        )],
        *[(f"call {x} now", "phone", [x]) for x in ("plus 49 171 2345678", "[+]49 171 2345678", "plus 49 dot 171 dot 2345678")],
        ("4111 1111 1111 111 one", "card", ["4111 1111 1111 111 one"]),
        *[(f"{_CARD_NAMES}{sep}{_CARD_NAMES}", "card", [_CARD_NAMES] * 2) for sep in ("\n", ", ", " / ")],
        ("one dot two dot three dot four, five dot six dot seven dot eight", "ip", ["one dot two dot three dot four", "five dot six dot seven dot eight"]),
        ("four, " + _CARD_NAMES[5:], "card", ["four, " + _CARD_NAMES[5:]]),
    ],
)
def test_pii_disguised_numbers_map_back(text, kind, spans):
    base, every = pii.detect(text)
    assert [(k, text[s:e]) for k, s, e in every if (k, s, e) not in base] == [(kind, x) for x in spans]


@pytest.mark.parametrize("text", ["reach me at example.com", "he sat at home. dot com", "one two three four five", "un deux trois", ""])
def test_pii_leaves_plain_text_alone(text):
    assert pii.detect(text) == ([], [])


def test_pii_edge_rows(spark, edge):
    rows = pii.with_pii(edge).collect()
    assert len(rows) == len(EDGE)
    masked = {r.doc_id: r.text for r in pii.mask_pii(edge).collect()}
    assert masked[10] == "mail me: <EMAIL> or <PHONE>" and masked[1] is None
    assert pii.mask_pii(edge).columns == edge.columns
    assert pii.with_pii(edge.limit(0)).count() == 0


@pytest.mark.parametrize("ranges", [4, 512])
def test_sharding_law_and_slots(spark, sf, ranges):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    texts = docs.select("doc_id", "text").collect()
    rows = sharding.shard_by_bytes(docs, 16, ranges=ranges).collect()
    assert len(rows) == len(texts)
    order = sorted(texts, key=lambda r: (hashlib.md5(r.text.encode()).hexdigest(), -1 if r.doc_id is None else r.doc_id))
    total, at, slots, want = sum(len(r.text.encode()) + 1 for r in texts), 0, defaultdict(int), set()
    for r in order:
        size = len(r.text.encode()) + 1
        shard = min(15, at * 16 // total)
        want.add((r.doc_id, size, zlib.crc32(r.text.encode()), "bytes", shard, slots[shard], None))
        slots[shard] += 1
        at += size
    assert {tuple(r)[:7] for r in rows} == want


def test_sharding_edge_rows(spark, edge):
    rows = sharding.shard_by_bytes(edge, 4, ranges=8).collect()
    assert len(rows) == len(EDGE)
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert sharding.shard_by_bytes(edge.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "label", "floor"), [("op4_quality", "quality", 0.9), ("op7_toxicity", "toxic", 0.85)])
def test_classifiers_hold_out(spark, name, label, floor):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) >= floor


def test_classifiers_edge_rows(spark, edge):
    labels = spark.createDataFrame([(4, 1, 1), (8, 0, 0), (8, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for fit, score, label in ((quality.fit, quality.score, "quality"), (toxicity.fit, toxicity.score, "toxic")):
        rows = score(edge, fit(edge, labels, label)).collect()
        assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
        assert len(score(edge, fit(edge, labels.limit(0), label)).collect()) == len(EDGE)


def test_misspellings_share_vectors():
    rng = np.random.default_rng(2)
    pool = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(300)]
    texts = [" ".join(rng.choice(pool, 60)) for _ in range(300)]
    y = [int(k % 4 == 0) for k in range(300)]
    texts = [t + " disgusting " + " ".join(rng.choice(pool, 5)) if v else t for t, v in zip(texts, y)]
    figure, bias = toxicity.train(texts, y)
    got = toxicity.probabilities(["that is disgustting to see", "that is pleasant to see"], figure, bias)
    assert got[0] > 0.7 > 0.5 > got[1]


def test_langid_hold_out_and_mixtures(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_langid(spark, sf).collect()
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.97
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    one = {r.lang: r.text for r in docs.where("n_chars > 1500").collect()}
    mixed = spark.createDataFrame([(one["en"][:1000] + " " + one["fr"][:500],)], "text string")
    mix = {m.lang: m.share for m in langid.predict(mixed, model).first().lang_mix}
    assert set(mix) == {"en", "fr"} and 0.5 < mix["en"] < 0.8


def test_langid_edge_rows(spark, edge):
    docs = edge.withColumn("lang", F.when(F.col("doc_id") == 10, "en"))
    rows = langid.identify(docs, F.lit(True)).collect()
    assert len(rows) == len(EDGE)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred == "en" for r in rows if r.doc_id == 4)
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    v = [(i, [float(x) for x in rng.normal(size=20)]) for i in range(300)] + [(i, [0.5] * 20) for i in range(300, 340)]
    v += [(900, None), (901, [1.0, None]), (902, [float("nan")] * 20), (None, [1.0] * 20), (950, [2.0, 3.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    m = {i: np.pad(np.floor(np.array(x) * 256).astype(int), (0, 20 - len(x))) for i, x in v if i is not None and i not in (900, 901, 902)}
    want = set()
    for q in [i for i in m if i % 50 == 0]:
        best = sorted((-int(m[q] @ m[c]), c) for c in m if c != q)[:5]
        want |= {(q, k, c, -s) for k, (s, c) in enumerate(best, 1)}
    for blocks in ({}, {"query_block": 3, "candidate_block": 40}):
        assert {tuple(r) for r in topk.top_k(df, **blocks).collect()} == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_decontamination_recall_and_precision(spark):
    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rng = np.random.default_rng(4)
    b = decontam.Benchmark(items)
    plain = [t for t, hit in zip(docs.values(), range(300)) if not decontam.leaks(b, [t])]
    texts, want = [], []
    for k, t in enumerate(plain):
        item, words = items[k % len(items)]
        words = words.split()
        for p in rng.choice(len(words), int(len(decontam.words_of(items[k % len(items)][1])) * 0.15), replace=False):
            words[p] = ["", "qqx", words[p] + " zzq"][int(rng.integers(3))]
        at = int(rng.integers(len(t.split()) + 1))
        texts.append(" ".join(t.split()[:at] + words + t.split()[at:]))
        want.append(item)
    found = {(d, b.items[k][0]) for d, k, *_ in decontam.leaks(b, texts)}
    assert np.mean([(d, i) in found for d, i in enumerate(want)]) >= 0.98
    got = {(r.doc_id, r.item_id): r.edit_distance for r in queries.op8_decontamination(spark, sf).collect()}
    for d, t in docs.items():
        own = decontam.words_of(t)
        for i, item in items:
            w = decontam.words_of(item)
            if w[0] in own and any(own[k : k + len(w)] == w for k in range(len(own) - len(w) + 1)):
                assert got[d, i] == 0


def test_decontamination_edge_rows(spark, edge):
    items = spark.createDataFrame([(1, "a b c d"), (2, ""), (3, None), (None, "x y z"), (4, "one")], "item_id long, text string")
    rows = decontam.find_leaks(edge, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(7, 1), (9, 1), (None, 1), (4, 4), (5, 4)}
    assert decontam.drop_contaminated(edge, items).columns == edge.columns
    assert decontam.drop_contaminated(edge, items.limit(0)).count() == len(EDGE)
    assert decontam.find_leaks(edge.limit(0), items).count() == 0


def _library(ranks):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_library(spark, sf):
    path, pattern = queries.tokenizer()
    ranks = bpe.load_ranks(path)
    library, codec = _library(ranks), bpe.Codec(ranks, pattern)
    rng = np.random.default_rng(6)
    parts = [*"ab cdeé  \n\t'sll019…漢字🙂\x1c\x85\xa0²½_", "the", "ing", " a", "aaaa", "'re"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(3000)] + ["a" * 20_000, "ab" * 3000, "", " " * 999]
    assert [x.tolist() for x in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op9_bpe(spark, sf).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_bpe_edge_rows_and_decoding(spark, edge):
    path, pattern = queries.tokenizer()
    rows = bpe.with_tokens(edge, path, pattern).select("doc_id", "text", "tokens.*")
    back = bpe.decode_ids(rows, path).collect()
    assert len(back) == len(EDGE) and all(bytes(r.decoded) == (r.text or "").encode() for r in back)


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>"</script></head><body><nav><a href="/x">menu</a></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title {0}</h1><p>First &amp; <b>bo</b>ld {0}<br>line {0}
<p>Second\n  part {0}</p><div class="comments"><p>nice post</p></div></article><aside>side</aside><footer>&copy; x</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.format(k)) for k in range(8)] + [(20, None, None), (21, "http://b/", ""), (22, "x", "plain &lt; text")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert all(got[k] == f"Title {k} First & bold {k} line {k} Second part {k}" for k in range(8))
    assert got[20] == got[21] == "" and got[22] == "plain < text"
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_template_without_semantic_tags(spark):
    page = '<body><div class="w"><div class="t">Site name</div><div class="c"><p>Own text {0} of page {0}, long enough to count as its content.</p><p>Share now</p></div><div class="x">a{0}</div></div></body>'
    rows = [(k, f"http://a.example/{k}", page.format(k)) for k in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text 3 of page 3, long enough to count as its content."


def _texts(spark, pages):
    rows = [(k, f"http://{host}/?utm={k}", html) for k, (host, html) in enumerate(pages)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[k] for k in range(len(rows))]


BARE = '<body><div class="w"><div class="c"><p>{}</p><p>{}</p></div></div></body>'


def test_html_keeps_frequent_article_text(spark):
    """Copies of one article, under article elements and without; a shared heading; the same with 4 pages and with 5."""
    own = lambda k: f"Own words number {k} that only this page has, in a line of some length."
    pages = [("copies", PAGE.format(1))] * 10 + [("bare", BARE.format("One heading", "one article, copied ten times over"))] * 10
    pages += [("near", BARE.format("One long article that all of the versions of this page share", f"version {k}")) for k in range(10)]
    pages += [("heads", f"<body><article><h1>Weekly news</h1><p>{own(k)}</p></article></body>") for k in range(10)]
    for n in (4, 5):
        pages += [(f"n{n}", BARE.format(own(k), "Share now")) for k in range(n)]
    got = _texts(spark, pages)
    assert got[:10] == ["Title 1 First & bold 1 line 1 Second part 1"] * 10
    assert got[10:20] == ["One heading one article, copied ten times over"] * 10
    assert got[20:30] == [f"One long article that all of the versions of this page share version {k}" for k in range(10)]
    assert got[30:40] == [f"Weekly news {own(k)}" for k in range(10)]
    assert got[40:44] == got[44:48] == [own(k) for k in range(4)]


def test_html_keeps_all_parts_without_semantic_tags(spark):
    """A lead of 30 % beside its body, a summary on some pages only, and a node name with the path's own sign."""
    lead, body = "Lead {0} of the text, some thirty of a hundred.", "Body {0} of the text: it goes on for much longer than the lead does, and it ends with {0}."
    page = '<body><div class="site">Site name here</div><div class="content [&>p]:x"><div class="lead"><h1>Head</h1><p>%s</p></div><div class="body"><p>%s</p></div></div>{1}</body>' % (lead, body)
    more = lambda k: f'<div class="end"><p>Summary of text {k}</p></div>' if k == 3 else ""
    got = _texts(spark, [("a.example", page.format(k, more(k))) for k in range(8)])
    for k in range(8):
        assert got[k] == f"{lead} {body}".format(k) + (" Summary of text 3" if k == 3 else "")


def test_html_query_matches_article_elements(spark, sf):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op10_html(spark, sf).collect():
        own = re.sub(r"</?(?:p|h1|br)[^>]*>", "\n", re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1])
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", "", own)).split()) and r.n_chars == len(r.text)


def test_pipeline_matches_brute_force(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    lang = {r.doc_id for r in queries.op5_langid(spark, sf).collect() if r.lang_pred != "und"}
    assert lang == {r.doc_id for r in docs if any(c.isalpha() for c in r.text)}
    kept = [r for r in docs if r.doc_id in lang]
    prints = [simhash.fingerprint(r.text) for r in kept]
    root = _union(len(kept), [(i, j) for i in range(len(kept)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = defaultdict(lambda: 10**18)
    for k, r in zip(root, kept):
        least[k] = min(least[k], r.doc_id)
    kept = [r for k, r in zip(root, kept) if least[k] == r.doc_id]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    b = decontam.Benchmark(items)
    kept = [r for r in kept if not decontam.leaks(b, [r.text])]
    library = _library(bpe.load_ranks(queries.tokenizer()[0]))
    want = {r.doc_id: library.encode_ordinary(pii.masked(r.text, pii.detect(r.text)[1])) for r in kept}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want
