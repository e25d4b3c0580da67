"""Input tables of the evaluation queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import normalize_ws, tokens
from palimpsest.sources.shared import cut

#: Candidates of an example.
BEAMS = 5


# The twins state their constants themselves.
SQL_BLANK = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _ws(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{SQL_BLANK}]+', ' ', 'g'))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def example_id(conv: Column, turn: Column) -> Column:
    """An id of its own for every turn: conv_id * 100 + turn up to turn 99; later turns count from the least long on, by
    conversation, turn and the turn's number of bits. What a long cannot hold is an error."""
    bits = F.length(F.bin(turn))
    later = (conv * F.call_function("shiftleft", F.lit(1).cast("long"), bits) + turn) * 64 + bits
    return F.when(turn >= 100, F.lit(-(2**63)) + later).otherwise(conv * 100 + turn)


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, source, target, context): a user's turn, the next turn, the one before (or empty); blanks evened. Rows
    of the same turn go by role and text."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").select(
        "role", example_id(F.col("conv_id"), F.col("turn")).alias("example_id"), normalize_ws(F.col("text")).alias("source"),
        normalize_ws(F.lead("text").over(w)).alias("target"), normalize_ws(F.coalesce(F.lag("text").over(w), F.lit(""))).alias("context"),
    )
    return rows.where((F.col("role") == "user") & F.col("target").isNotNull()).drop("role")


def candidates(pairs: DataFrame) -> DataFrame:
    """(example_id, beam_rank, pred, base_score, second_score): targets without every m-th token, m by rank."""
    ranked = pairs.select("example_id", tokens(F.col("target")).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(BEAMS - 1))).alias("beam_rank"))
    kept = F.filter("t", lambda x, i: (i + F.col("example_id")) % (4 + F.col("beam_rank")) != 0)
    return ranked.select(
        "example_id", "beam_rank", F.array_join(kept, " ").alias("pred"),
        ((F.pmod("example_id", F.lit(97)) * 31 + F.col("beam_rank") * 17) % 97 / 97.0).alias("base_score"),
        ((F.pmod("example_id", F.lit(89)) * 13 + F.col("beam_rank") * 41) % 89 / 89.0).alias("second_score"),
    )


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, src, ref, pred, ctx): the pairs with their rank-0 candidates, joined by narrow projection."""
    pairs = turn_pairs(spark, sf_dir)
    kept = F.filter(tokens(F.col("target")), lambda x, i: (i + F.col("example_id")) % 4 != 0)
    return pairs.select("example_id", F.col("source").alias("src"), F.col("target").alias("ref"), F.array_join(kept, " ").alias("pred"), F.col("context").alias("ctx"))


def refs_multi(pairs: DataFrame) -> DataFrame:
    """(example_id, ref_idx, ref): the target, without its first token, without its last."""
    t = tokens(F.col("target"))
    n = F.greatest(F.size(t) - 1, F.lit(0))
    forms = F.array(F.array_join(t, " "), F.array_join(F.slice(t, 2, n), " "), F.array_join(F.slice(t, 1, n), " "))
    return pairs.select("example_id", F.posexplode(forms).alias("ref_idx", "ref"))


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): documents and benchmark items, whose ids are counted down from -1; blanks evened. Corruption leaves
    the long ones out."""
    line = lambda name, key: table(spark, sf_dir, name).select(key.alias("id"), normalize_ws(F.col("text")).alias("text"))
    return line("documents", F.col("doc_id")).unionByName(line("benchmark", -1 - F.col("item_id")))


def edit_pairs(spark: SparkSession, sf_dir: str, most: int = 512) -> DataFrame:
    """(example_id, source_id, source, target): documents of more than 200 characters and at most ``most`` tokens that
    begin with the same 60 characters as the least such document but differ from it; blanks evened. One pair for each
    document, so a group of copies gives no more pairs than it has rows."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 200).select("doc_id", normalize_ws(F.col("text")).alias("text"))
    # Evened texts are written once: every later filter and both sides of the join would even them again.
    docs = cut(docs).where(F.size(F.split("text", " ")) <= most).withColumn("head", F.substring("text", 1, 60))
    # A text travels only where another one begins like it.
    source = docs.select(F.col("doc_id").alias("source_id"), F.col("head").alias("source_head"), F.col("text").alias("source"))
    many = docs.groupBy("head").agg(F.count("*").alias("n"), F.min("doc_id").alias("source_id")).where("n > 1").join(source, "source_id").where("head = source_head")
    found = docs.join(many.select("head", "source_id", "source"), "head").where(F.col("text") != F.col("source"))
    return found.select(F.col("doc_id").alias("example_id"), "source_id", "source", F.col("text").alias("target"))


SQL_EDIT_PAIRS = f"""
eligible as (select doc_id, {_ws("text")} as text from documents where length(text) > 200),
short as (select *, substr(text, 1, 60) as head from eligible where len(list_filter(string_split(text, ' '), lambda x: x <> '')) <= 512),
least as (select head, min(doc_id) as source_id, arg_min(text, doc_id) as source from short group by head),
edits as (select doc_id as example_id, source_id, source, text as target from short join least using (head) where text <> source)"""


def _sides(rows: DataFrame) -> DataFrame:
    both = F.array(*[F.struct(F.lit(s).alias("side"), tokens(F.col(c)).alias("t")) for s, c in (("ref", "ref"), ("hyp", "pred"))])
    return rows.select("example_id", F.explode(both).alias("x")).select("example_id", "x.side", "x.t")


def subtrees(rows: DataFrame) -> DataFrame:
    """(example_id, side, sexp, depth): every token above the one behind it, as trees of two levels."""
    pairs = F.transform(F.slice("t", 2, F.size("t")), lambda w, i: F.concat(F.lit("("), F.get("t", i), F.lit(" ("), w, F.lit("))")))
    return _sides(rows).select("example_id", "side", F.posexplode(pairs).alias("depth", "sexp"))


def dataflow_edges(rows: DataFrame) -> DataFrame:
    """(example_id, side, pos, var, relation, src_vars, src_pos): tokens come from the token before, every third from
    nothing; and every fifth is also computed from the token three before."""
    def edge(w, i, relation: str, back: int, some):
        has = some & (i >= back)
        at = lambda c, kind: F.when(has, F.array(c)).otherwise(F.array().cast(kind))
        return F.struct(
            i.alias("pos"), w.alias("var"), F.lit(relation).alias("relation"),
            at(F.get("t", F.greatest(i - back, F.lit(0))), "array<string>").alias("src_vars"), at(i - back, "array<int>").alias("src_pos"),
        )

    first = F.transform("t", lambda w, i: edge(w, i, "comesFrom", 1, i % 3 != 0))
    second = F.filter(F.transform("t", lambda w, i: edge(w, i, "computedFrom", 3, i % 5 == 4)), lambda e: F.size(e["src_pos"]) > 0)
    return _sides(rows).select("example_id", "side", F.explode(F.concat(first, second)).alias("e")).select("example_id", "side", "e.*")


_TOK = "list_filter(string_split({}, ' '), lambda x: x <> '')"
_SQL_BITS = "length(bin(turn))"
SQL_PAIRS = f"""
turns as (
  select role, text, lead(text) over w as nxt, coalesce(lag(text) over w, '') as prv, case when turn < 100 then conv_id * 100 + turn
    else (-9223372036854775807 - 1) + (conv_id * (1::bigint << {_SQL_BITS}) + turn) * 64 + {_SQL_BITS} end as example_id
  from conversations window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first)
), pairs as (
  select example_id, {_ws("text")} as source, {_ws("nxt")} as target, {_ws("prv")} as context
  from turns where role = 'user' and nxt is not null
)"""
SQL_CANDIDATES = f"""{SQL_PAIRS}, candidates as (
  select example_id, beam_rank::int as beam_rank,
    array_to_string(list_filter({_TOK.format("target")}, lambda x, i: (i - 1 + example_id) % (4 + beam_rank) <> 0), ' ') as pred,
    (((example_id % 97 + 97) % 97 * 31 + beam_rank * 17) % 97) / 97.0::double as base_score,
    (((example_id % 89 + 89) % 89 * 13 + beam_rank * 41) % 89) / 89.0::double as second_score
  from pairs, range(5) r(beam_rank)
)"""
SQL_EVAL = f"""{SQL_CANDIDATES}, evals as (
  select p.example_id, p.source as src, p.target as ref, c.pred, p.context as ctx
  from pairs p join candidates c on p.example_id = c.example_id and c.beam_rank = 0
)"""
SQL_REFS = f"""{SQL_EVAL}, refs as (
  select example_id, ref_idx::int as ref_idx, array_to_string(case ref_idx when 0 then t when 1 then t[2:] else t[:len(t) - 1] end, ' ') as ref
  from (select example_id, {_TOK.format("target")} as t from pairs), range(3) r(ref_idx)
)"""
