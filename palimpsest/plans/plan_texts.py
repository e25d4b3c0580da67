"""Opcodes and plans as they are written, beside SQL that finds them by itself.

The twin finds the longest common run of a pair's rest, again and again to its left and right, from the table of all
equal places; so a plan that merely leads to the right text, such as one that replaces everything, does not match it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import edits, plans
from palimpsest.plans import queries as Q
from palimpsest.sources import views as V


def _runs(places: str) -> str:
    """The diagonal runs [i0, i1) of a table of equal places (example_id, i, j)."""
    return f"""select example_id, i - j as d, min(i) as i0, max(i) + 1 as i1 from (
    select *, i - row_number() over (partition by example_id, i - j order by i) as g from {places}) group by example_id, i - j, g"""


#: A rectangle's longest run of unpopular tokens, the first in the old and then in the new text, and how far equal tokens go on from it.
_BLOCK = """
  select example_id, alo, ahi, blo, bhi, start as bi, start - d as bj, stop - start as size from (
    select p.*, case when best is null then s else greatest(f.i0, alo, blo + p.d) end as start, least(f.i1, ahi, bhi + p.d) as stop
    from (
      select *, case when best is null then alo else 99999 - (best // 100000) % 100000 end as s, case when best is null then alo - blo else best % 100000 - 50000 end as d
      from (
        select r.example_id, alo, ahi, blo, bhi,
          max((least(i1, ahi, bhi + d) - greatest(i0, alo, blo + d)) * 10000000000 + (99999 - greatest(i0, alo, blo + d)) * 100000 + d + 50000) as best
        from rects r left join core c on c.example_id = r.example_id and least(i1, ahi, bhi + d) > greatest(i0, alo, blo + d)
        group by r.example_id, alo, ahi, blo, bhi)) p
    join full_runs f on f.example_id = p.example_id and f.d = p.d and f.i0 <= p.s and p.s < f.i1)
  where stop > start"""


def sql_ops(pairs: str, table: str) -> str:
    """CTEs w (example_id, a, b: tokens) and ops (example_id, k, tag, lo, hi, st, en) of the pairs."""
    return f"""with recursive {pairs}, w as (select example_id, {V._TOK.format('source')} as a, {V._TOK.format('target')} as b from {table}
), ta as (select example_id, generate_subscripts(a, 1) - 1 as i, unnest(a) as t from w), tb as (select example_id, generate_subscripts(b, 1) - 1 as j, unnest(b) as t from w
), popular as (select example_id, t from tb join (select example_id, len(b) as n from w) using (example_id) group by example_id, t, n having n >= 200 and count(*) > n // 100 + 1
), same as (select ta.example_id, i, j, ta.t from ta join tb on ta.example_id = tb.example_id and ta.t = tb.t
), rare as (select same.* from same left join popular p on p.example_id = same.example_id and p.t = same.t where p.t is null
), full_runs as ({_runs("same")}), core as ({_runs("rare")}
), rects as (
  select example_id, 0::bigint as alo, len(a)::bigint as ahi, 0::bigint as blo, len(b)::bigint as bhi from w
  union all
  select example_id, c.alo, c.ahi, c.blo, c.bhi from (
    select example_id, unnest([{{'alo': alo, 'ahi': bi, 'blo': blo, 'bhi': bj}}, {{'alo': bi + size, 'ahi': ahi, 'blo': bj + size, 'bhi': bhi}}]) as c from ({_BLOCK}))
  where c.alo < c.ahi and c.blo < c.bhi
), blocks as ({_BLOCK}
), joined as (
  -- Blocks that go on from each other are one.
  select example_id, min(bi) as i, min(bj) as j, sum(size)::bigint as n from (
    select *, sum(case when bi = pi and bj = pj then 0 else 1 end) over (partition by example_id order by bi) as g from (
      select *, lag(bi + size) over o as pi, lag(bj + size) over o as pj from blocks window o as (partition by example_id order by bi)))
  group by example_id, g
), ends as (
  select example_id, i, j, n, coalesce(lag(i + n) over o, 0) as pi, coalesce(lag(j + n) over o, 0) as pj
  from (select * from joined union all select example_id, len(a), len(b), 0 from w) window o as (partition by example_id order by i, j, n desc)
), parts as (
  select example_id, case when pi < i and pj < j then 'replace' when pi < i then 'delete' else 'insert' end as tag, pi as lo, i as hi, pj as st, j as en from ends where pi < i or pj < j
  union all select example_id, 'equal', i, i + n, j, j + n from ends where n > 0
), ops as (select *, row_number() over (partition by example_id order by lo, hi, st, en) - 1 as k from parts)"""


_SIDES = "array_to_string(a[lo + 1:hi], ' ') as o, array_to_string(b[st + 1:en], ' ') as n"
_ALONE = lambda mark: f"array_to_string(list_transform(a[lo + 1:hi], lambda x: '{mark}'), ' ')"
_BOTH = lambda side, mark: f"array_to_string(list_transform({side}, lambda x: '{mark} ' || x), ' ')"
_OLD, _NEW = "a[lo + 1:hi]", "b[st + 1:en]"


def _written(view, table: str):
    """Code plan, commands and labels of each pair of a view, as texts."""
    def query(spark, d):
        old, new = T.tokens(F.col("source")), T.tokens(F.col("target"))
        p = view(spark, d).select("example_id", old.alias("o"), new.alias("n")).withColumn("ops", edits.edit_opcodes("o", "n"))
        made = {"plan": edits.code_edit_plan, "commands": edits.edit_commands, "labels": plans.edit_token_labels}
        return p.select("example_id", *[F.array_join(f(F.col("ops"), F.col("o"), F.col("n")), " ").alias(k) for k, f in made.items()])

    pairs = V.SQL_PAIRS if table == "pairs" else V.SQL_EDIT_PAIRS
    return query, f"""{sql_ops(pairs, table)}, each as (select ops.*, a, b, {_SIDES} from ops join w using (example_id)
), written as (
  select example_id, k,
    case tag when 'equal' then '<KEEP> ' || o || ' <KEEP_END>' when 'delete' then '<DELETE> ' || o || ' <DELETE_END>' when 'insert' then '<INSERT> ' || n || ' <INSERT_END>'
      else '<REPLACE_OLD> ' || o || ' <REPLACE_NEW> ' || n || ' <REPLACE_END>' end as plan,
    case tag when 'equal' then {_ALONE('<KEEP>')} when 'delete' then {_ALONE('<DELETE>')} when 'insert' then {_BOTH(_NEW, '<INSERT>')}
      else {_ALONE('<REPLACE_OLD>')} || ' ' || {_BOTH(_NEW, '<REPLACE_NEW>')} end as commands,
    case tag when 'equal' then {_BOTH(_OLD, '<KEEP>')} when 'delete' then {_BOTH(_OLD, '<DELETE>')} when 'insert' then {_BOTH(_NEW, '<INSERT>')}
      else {_BOTH(_OLD, '<REPLACE_OLD>')} || ' ' || {_BOTH(_NEW, '<REPLACE_NEW>')} end as labels
  from each
)
select example_id, coalesce(string_agg(plan, ' ' order by k), '') as plan, coalesce(string_agg(commands, ' ' order by k), '') as commands, coalesce(string_agg(labels, ' ' order by k), '') as labels
from w left join written using (example_id) group by example_id"""


def q_opcode_table(spark, d):
    p = Q.pairs(spark, d).select("example_id", edits.edit_opcodes(T.tokens(F.col("source")), T.tokens(F.col("target"))).alias("ops"))
    return p.select("example_id", F.posexplode("ops").alias("op_idx", "op")).select("example_id", "op_idx", "op.*")


def _places(lo: str, hi: str) -> str:
    """How often a part of the old text stands in it."""
    return f"len(list_filter(range(0, len(a) - ({hi} - {lo}) + 1), lambda i: a[i + 1:i + {hi} - {lo}] = a[{lo} + 1:{hi}]))"


def _least_width(most: str, lo: str, hi: str) -> str:
    return f"list_filter(range(1, {most} + 1), lambda g: {_places(lo, hi)} = 1)[1]"


def _minimal(view, table: str):
    """Minimal plans of each pair of a view in both modes, as texts."""
    def query(spark, d):
        old, new = T.tokens(F.col("source")), T.tokens(F.col("target"))
        return view(spark, d).select("example_id", *[F.array_join(plans.edit_plan(mode, old, new), " ").alias(mode) for mode in ("other", "comment")])

    pairs = V.SQL_PAIRS if table == "pairs" else V.SQL_EDIT_PAIRS
    stem = "case tag when 'delete' then 'REPLACE_{}_DELETE' when 'replace' then 'REPLACE_{}' else 'INSERT_{}' end"
    marked = lambda x: f"'<' || replace({stem}, '{{}}', '{x}') || '_KEEP_' || side || '>'"
    return query, f"""{sql_ops(pairs, table)}, changes as (
  select o.*, row_number() over (partition by o.example_id order by o.k) as c, p.lo as before, n.hi as behind
  from ops o left join ops p on p.example_id = o.example_id and p.k = o.k - 1 and p.tag = 'equal' left join ops n on n.example_id = o.example_id and n.k = o.k + 1 and n.tag = 'equal'
  where o.tag <> 'equal'
), grown as (
  select example_id, 0::bigint as c, ''::varchar as tag, 0::bigint as lo, 0::bigint as hi, 0::bigint as st, 0::bigint as en, ''::varchar as side, 0::bigint as g, 0::bigint as free from w
  union all
  select example_id, c, tag, lo, hi, st, en, case when alone then '' when left_ is not null then 'BEFORE' when right_ is not null then 'AFTER' else 'NONE' end, 
    case when alone then 0 else coalesce(left_, right_, 0) end, case when not alone and left_ is null and right_ is not null then hi + right_ else free end
  from (
    select *, case when not alone and before is not null and greatest(free, before) < lo then {_least_width("lo - greatest(free, before)", "(lo - g)", "hi")} end as left_,
      case when not alone and behind is not null then {_least_width("behind - hi", "lo", "(hi + g)")} end as right_
    from (
      select x.example_id, x.c, x.tag, x.lo, x.hi, x.st, x.en, x.before, x.behind, y.free, w.a, x.tag <> 'insert' and {_places("x.lo", "x.hi")} = 1 as alone
      from grown y join changes x on x.example_id = y.example_id and x.c = y.c + 1 join w on w.example_id = x.example_id))
), each as (
  select grown.*, w.a, w.b, array_to_string(a[lo + 1:hi], ' ') as o, array_to_string(b[st + 1:en], ' ') as n, array_to_string(case side when 'BEFORE' then a[lo - g + 1:lo] when 'AFTER' then a[hi + 1:hi + g] else [] end, ' ') as kept
  from grown join w using (example_id) where c > 0
), sided as (
  select *, trim(case side when 'BEFORE' then kept || ' ' || o else o || ' ' || kept end) as olds, trim(case side when 'BEFORE' then kept || ' ' || n else n || ' ' || kept end) as news from each
), written as (
  select example_id, c, side,
    case when side = '' and tag = 'delete' then '<DELETE> ' || o || ' <DELETE_END>' else '<REPLACE_OLD> ' || olds || ' <REPLACE_NEW> ' || case when news = '' then '' else news || ' ' end || '<REPLACE_END>' end as other,
    case when side = '' and tag = 'delete' then '<DELETE> ' || o || ' <DELETE_END>' when side = '' then '<REPLACE_OLD> ' || olds || ' <REPLACE_NEW> ' || news || ' <REPLACE_END>'
      else {marked('OLD')} || ' ' || olds || ' ' || {marked('NEW')} || ' ' || case when news = '' then '' else news || ' ' end || case tag when 'insert' then '<INSERT_END>' else '<REPLACE_END>' end end as comment
  from sided
), whole as (select example_id, array_to_string(list_concat(list_concat(['<REPLACE_OLD>'], a), list_concat(['<REPLACE_NEW>'], list_concat(b, ['<REPLACE_END>']))), ' ') as all_ from w)
select example_id, case when bool_or(side = 'NONE') then any_value(all_) else coalesce(string_agg(other, ' ' order by c), '') end as other,
  case when bool_or(side = 'NONE') then any_value(all_) else coalesce(string_agg(comment, ' ' order by c), '') end as comment
from whole left join written using (example_id) group by example_id"""


QUERIES = {
    "opcode_table": (q_opcode_table, f"{sql_ops(V.SQL_PAIRS, 'pairs')} select example_id, k::int as op_idx, tag, lo::int as o_start, hi::int as o_end, st::int as n_start, en::int as n_end from ops"),
    "code_plan_text": _written(Q.pairs, "pairs"),
    "near_copy_code_plan_text": _written(V.edit_pairs, "edits"),
    "minimal_plan_text": _minimal(Q.pairs, "pairs"),
    "near_copy_minimal_plan_text": _minimal(V.edit_pairs, "edits"),
}
