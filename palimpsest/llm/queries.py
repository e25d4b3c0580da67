"""The operators' registered queries: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, conversations, decontam, html_extract, langid, lexical, pieces, pii, quality, sharding, simhash, topk, toxicity
from palimpsest.llm.common import key_remainder, table, whole_text

#: Folds that the contracts name: modulus and held-out remainder.
LABEL_FOLD, LANG_FOLD = (3, 1), (4, 2)
TOXIC_FROM, QUALITY_FROM = 0.7, 0.5


def tokenizer() -> tuple[str, str]:
    """(ranks' file, pattern) of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _held_out(fold: tuple[int, int], id_col: str = "doc_id"):
    return F.coalesce(key_remainder(F.col(id_col), fold[0]) == fold[1], F.lit(False))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(pii.spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, "pii.base_sha256", F.col("pii.spans_written").alias("spans"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels.where(~_held_out(LABEL_FOLD)), "quality")
    scored = quality.score(docs.select("doc_id", "text"), weights)
    return scored.select(
        "doc_id", _held_out(LABEL_FOLD).alias("held_out"), "score", (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted")
    )


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, ~_held_out(LANG_FOLD))
    return found.select("doc_id", _held_out(LANG_FOLD).alias("held_out"), "lang_pred", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~_held_out(LABEL_FOLD)), "toxic")
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", _held_out(LABEL_FOLD).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), *tokenizer(), keep_ids=False)
    return coded.select("doc_id", "tokens.*")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length(whole_text()).cast("long").alias("n_chars"))


def piece_model() -> str:
    """The public model file that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.with_pieces(docs, piece_model(), keep_ids=False, keep_text=False).select("doc_id", "pieces.*")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")), gone="gone")


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_pii, op3_sharding, op4_quality, op5_langid, op6_topk, op7_toxicity, op8_decontamination, op9_bpe, op10_html,
        op11_sentencepiece, op12_lexical, op13_conversations,
    )
}

#: crc32 of a string of ASCII signs, bit by bit.
_CRC32 = """xor(list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::bigint), lambda a, b:
  list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)) + y), 4294967295::bigint), 4294967295)"""


def _least(*options: str) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x is not null))"


def _edit(state: str, cost: str, letter: str, line: str = "''") -> str:
    """A state's path with one more edit: cost and letters, by which paths are compared, and the text that they leave."""
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} end"


def _repair_step() -> str:
    """The paths to each state when a row has been edited, from those before it; n, s, u, a: nothing, system, user, assistant."""
    writes = lambda line: f"(chr(10) || {line})"
    to_u, to_a = ("n", "s", "a"), ("u",)
    kept = lambda froms, initial: [f"case when left(role, 1) = '{initial}' and not must_go then {_edit(q, 'late', 'K', writes("role || ':' || text"))} end" for q in froms]
    reroled = lambda froms, name: [f"case when not must_go then {_edit(q, '2 + late', 'R', writes(f"'{name}:' || text"))} end" for q in froms]
    return f"""{_least(_edit("n", "3", "D"))} as n, {_least(_edit("s", "3", "D"), *kept(("n",), "s"))} as s,
      {_least(_edit("u", "3", "D"), *kept(to_u, "u"), *reroled(to_u, "user"))} as u,
      {_least(_edit("a", "3", "D"), *kept(to_a, "a"), *reroled(to_a, "assistant"))} as a"""


_INSERT_U, _INSERT_A = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_BOTH = f"{_INSERT_U} || {_INSERT_A}"
_INSERTED = f"""n, s, {_least("u", *(_edit(q, "2", "I", _INSERT_U) for q in "nsa"))} as u,
      {_least("a", _edit("u", "2", "I", _INSERT_A), *(_edit(q, "4", "II", _BOTH) for q in "ns"))} as a"""

ORACLE_SQL = {
    "op13_conversations": rf"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
  from conversations
), hashed as (select *, {_CRC32} % 20 as h from keyed
), harmed as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case h when 0 then [] when 3 then [0, 1] else [0] end) as copy
  from hashed
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
  from harmed
), judged as (
  select *, case when body = '' then 'blank' when nth > 1 then 'duplicate' when right(body, 1) in ('.', '!', '?') then '' else 'truncated' end as fault,
    lag(left(role, 1)) over (partition by conv_id order by i) || '>' || left(role, 1) as pair
  from placed
), counted as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (pair is not null and pair not in ('s>u', 'u>a', 'a>u')) as illegal
  from judged group by conv_id
), edits as (select conv_id, i, role, text, fault in ('blank', 'duplicate') as must_go, (fault = 'truncated')::bigint as late from judged
), started as (
  select conv_id, 0::bigint as i, {{'c': 0::bigint, 'a': '', 't': ''}} as n, null::struct(c bigint, a varchar, t varchar) as s,
    {{'c': 2::bigint, 'a': 'I', 't': {_INSERT_U}}} as u, {{'c': 4::bigint, 'a': 'II', 't': {_BOTH}}} as a
  from counted
), paths as (
  select * from started
  union all
  select conv_id, i, {_INSERTED} from (
    select p.conv_id, e.i, {_repair_step()} from paths p join edits e on p.conv_id is not distinct from e.conv_id and e.i = p.i + 1)
), ended as (
  select c.*, {_least("p.n", "p.a")} as best from counted c join paths p on p.conv_id is not distinct from c.conv_id and p.i = c.n
)
select k.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit,
  sha256(coalesce(best.t[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) k left join ended e on k.conv_id is not distinct from e.conv_id
""",
    "op12_lexical": r"""
with words as (
  select row_number() over () as row, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents
), wanted as (
  select distinct item_id, term from (
    select item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark)
), sizes as (select row, any_value(doc_id) as doc_id, count(*) as n from words group by row
), whole as (select count(*) as docs, sum(n)::bigint as terms from sizes
), tfs as (select row, term, count(*) as tf from words where term in (select term from wanted) group by row, term
), weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tfs, whole group by term, docs
), impacts as (
  select t.row, s.doc_id, t.term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)) as impact
  from tfs t join sizes s using (row), whole
), scores as (
  select item_id, row, any_value(doc_id) as doc_id, sum(w * impact)::bigint as score
  from wanted join weights using (term) join impacts using (term) group by item_id, row
), ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank from scores where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
""",
    "op6_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
""",
}
