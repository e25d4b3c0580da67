"""Nesting by windows, functions of files and subtrees from node tables, against plain scans."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import code_tables, nesting, structure


def test_depths_spans_and_parents_match_a_stack(spark):
    """Texts that close too much or too little, tokens that do neither, a null key."""
    rnd = random.Random(4)
    texts = {k: rnd.choices("()x", k=rnd.randint(0, 40)) for k in range(30)}
    want = {}
    for k, signs in texts.items():
        stack, balance = [], 0
        for at, s in enumerate(signs):
            balance += (s == "(") - (s == ")")
            if s == "(":
                inner = [p for p, b in stack if b == balance - 1]
                want[k, at] = [balance, None, inner[-1] if inner else None]
                stack.append((at, balance))
            elif s == ")":
                for p, b in stack:
                    if b == balance + 1 and want[k, p][1] is None:
                        want[k, p][1] = at
    rows = [(k or None, at, s, "d") for k, signs in texts.items() for at, s in enumerate(signs)]
    df = spark.createDataFrame(rows, "id long, pos int, sign string, depth string")
    opens, closes = F.col("sign") == "(", F.col("sign") == ")"
    nested = nesting.span_nesting_depth(df, ["id"], opens, closes)
    got = {(r.id or 0, r.pos): r.depth for r in nested.collect()}
    assert got == {(k, at): d for k, signs in texts.items() for at, d in enumerate(accumulate((s == "(") - (s == ")") for s in signs))}
    spans = nesting.nested_parents(nesting.nested_spans(nested, ["id"], opens), ["id"])
    assert {(r.id or 0, r.pos): [r.depth, r.end, r.parent] for r in spans.collect()} == want
    assert nesting.nested_spans(nested.limit(0), ["id"], opens).count() == 0


def _java(words):
    """A scan from the left: an outermost function starts behind the last bound and ends where its block does."""
    out, i, floor = [], 0, 0
    while i < len(words):
        body = i + 1 if words[i : i + 2] == [")", "{"] else i + 3 if words[i : i + 2] == [")", "throws"] and words[i + 3 : i + 4] == ["{"] else None
        if body is None:
            i += 1
            continue
        at = i
        while at >= floor and words[at] not in code_tables.BOUNDS:
            at -= 1
        start = at + 1
        if at >= floor and words[at] in code_tables.OPENERS:
            back = at
            while back >= floor and words[back] != code_tables.OPENERS[words[at]]:
                back -= 1
            start = back if back >= floor else start
        end, depth = body, 0
        while end < len(words):
            depth += (words[end] == "{") - (words[end] == "}")
            end += 1
            if depth == 0:
                break
        out.append(words[start:end])
        i = floor = end
    return out


def _python(words):
    out, i = [], 0
    while i < len(words):
        if words[i] == "def":
            depth, end = 0, None
            for k in range(i, len(words)):
                depth += (words[k] == "INDENT") - (words[k] == "DEDENT")
                if words[k] == "DEDENT" and depth == 0:
                    end = k + 1
                    break
            if end is None:
                break
            out.append(words[i:end])
            i = end
        else:
            i += 1
    return out


@pytest.mark.parametrize("kind", ["java", "python"])
def test_functions_of_any_token_list_match_a_scan(spark, kind):
    rnd = random.Random(6)
    pool = [")", "{", "}", ";", "*/", "/*", "//", "ENDCOM", "throws", "f", ") {", ") {", ") throws E {"] if kind == "java" else ["def", "INDENT", "DEDENT", "a", "INDENT", "DEDENT", "def f"]
    files = {k: " ".join(rnd.choices(pool, k=rnd.randint(0, 50))).split() for k in range(150)}
    df = spark.createDataFrame([*files.items(), (999, None)], "id long, w array<string>")
    held, tokens = code_tables._tokens(df, "id", F.col("w"))
    if kind == "java":
        start = lambda c, floor: F.when((c["bound"] >= floor) & (c["opener"] >= floor), c["opener"]).when(c["bound"] >= floor, c["bound"] + 1).otherwise(floor)
        found = code_tables._cut_out(held, code_tables.java_spans(tokens, held.select("row", F.size("w").alias("size"))), start, "id")
    else:
        found = code_tables._cut_out(held, code_tables.python_spans(tokens), lambda c, floor: c["from"], "id")
    got = {}
    for r in found.orderBy("id", "idx").collect():
        got.setdefault(r.id, []).append(r.f)
    plain = _java if kind == "java" else _python
    assert got == {k: plain(w) for k, w in files.items() if plain(w)}


def _sexps(nodes, side):
    own = {n: (p, o, k, named) for s, n, p, o, k, named in nodes if s == side}
    down = {}
    for n, (p, *_) in own.items():
        down.setdefault(p if p in own else None, []).append(n)

    def write(n):
        inner = [write(c) for c in sorted(down.get(n, []), key=lambda c: (own[c][1], c)) if own[c][3] is not False]
        return f"({own[n][2]} {' '.join(inner)})"

    parents = {p for p, *_ in own.values()}
    return [write(n) for n in own if own[n][3] is not False and (n in parents or own[n][0] not in own)]


def test_subtrees_match_written_trees(spark):
    """Deep and wide trees, gaps in ordinals, orphans, several roots, unnamed nodes, a null example."""
    rnd = random.Random(8)
    rows, want = [], {}
    for example in (None, *range(25)):
        nodes = []
        for side in ("ref", "hyp"):
            for n in range(rnd.randint(0, 14)):
                parent = None if n == 0 or rnd.random() < 0.05 else n - 1 if rnd.random() < 0.5 else rnd.randrange(n)
                nodes.append((side, 100 + n, 99 if rnd.random() < 0.03 else None if parent is None else 100 + parent, 3 * n, rnd.choice("ab"), True))
        leaves = {n for _, n, *_ in nodes} - {p for _, _, p, *_ in nodes}
        nodes = [(s, n, p, o, k, rnd.choice([None, True, False]) if n in leaves and p is not None and p != 99 else True) for s, n, p, o, k, _ in nodes]
        ref, hyp = _sexps(nodes, "ref"), _sexps(nodes, "hyp")
        if ref or hyp:
            want[example] = (sum(x in hyp for x in ref), len(ref))
        rows += [(example, *r) for r in nodes]
    chain = [(50, s, n, n - 1 if n else None, 0, "c", None) for s in ("ref", "hyp") for n in range(70 if s == "ref" else 60)]
    want[50] = (59, 69)
    df = spark.createDataFrame(rows + chain, "example_id long, side string, node long, parent long, ordinal int, kind string, named boolean")
    table = structure.subtree_table(df)
    assert {r.example_id: (r.s_match, r.s_all) for r in structure.syntax_counts(table).collect()} == want
    assert max(r.depth for r in table.where("example_id = 50").collect()) == 69
    assert structure.subtree_table(df.drop("named").limit(0)).count() == 0
    circle = spark.createDataFrame([(1, "ref", 1, 2, 0, "a"), (1, "ref", 2, 1, 0, "a")], df.drop("named").schema)
    with pytest.raises(ValueError, match="circle"):
        structure.tree_paths(circle)
