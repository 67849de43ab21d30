"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

# crc32 over a list of bytes: crc_table.t holds its table, made by the definition.
_CRC_TABLE = """
crc_table as (select list(x order by i) t from (
  select i, list_reduce(range(8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, i) x from range(256) r(i)))"""


def _crc(data: str) -> str:
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


_BYTES = "flatten(list_transform(string_split({0}, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x) - 64] end))"

SPELLING = f"""
with recursive {_CRC_TABLE},
runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run
  from documents),
distinct_runs as (select doc_id, run, count(*) m, coalesce(doc_id::varchar, '') || ':' || run k from runs group by doc_id, run),
hashed as (select run, m, {_crc(_BYTES.format("k"))} h from distinct_runs, crc_table),
changed as (
  select case when h % 97 = 0 then run[: h % length(run)] || run[h % length(run) + 2 :] else run end word, m from hashed),
words as (select word, sum(m)::bigint n from changed where length(word) >= 5 group by word having sum(m) >= 3),
cuts as (select word, i, word[: i - 1] || word[i + 1 :] rest from (select word, unnest(range(1, length(word) + 1)) i from words)),
near as (
  select a.word, b.word other from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, w.word from cuts a join words w on a.rest = w.word
  union select w.word, a.word from cuts a join words w on a.rest = w.word),
best as (
  select near.word, count(*) n_near, min({{'less': -o.n, 'form': o.word}}) top from near join words o on near.other = o.word group by near.word),
formed as (
  select w.word, w.n, coalesce(n_near, 0) n_near, case when -top.less >= 2 * w.n then top.form end form, case when -top.less >= 2 * w.n then -top.less end form_n
  from words w left join best using (word)),
ways as (
  select word, word root, form next from formed
  union all select ways.word, f.word, f.form from ways join formed f on ways.next = f.word)
select f.word, f.form, ways.root, f.n, f.n_near, f.form_n from formed f join ways on f.word = ways.word where ways.next is null"""

# States of an edited conversation by its last role: 0 none, 1 s, 2 u, 3 a.
_STEP = """
select conv_id, {pos} as pos, way.role as role, min({{'cost': way.cost, 'audit': way.audit}}) as best from (
  select conv_id, unnest(list_concat(ways,
    list_transform(ways, lambda w: {{'role': case when w.role = 2 then 3 else 2 end, 'cost': w.cost + 5, 'audit': w.audit || 'I'}}),
    list_transform(list_filter(ways, lambda w: w.role <> 2), lambda w: {{'role': 3, 'cost': w.cost + 10, 'audit': w.audit || 'II'}}))) as way{more}
  from ({ways})) group by {by}"""

_FIRST = "select conv_id, [{'role': 0, 'cost': 0, 'audit': ''}] as ways from ids"
_WAYS = """
  select s.conv_id, r.pos, list_filter([
    {'role': s.role, 'cost': s.best.cost + 2, 'audit': s.best.audit || 'D'},
    {'role': case when s.role = 2 then 3 else 2 end, 'cost': s.best.cost + r.late + 1, 'audit': case when r.must then null else s.best.audit || 'R' end},
    {'role': r.own, 'cost': s.best.cost + r.late,
     'audit': case when not r.must and ((r.own = 1 and s.role = 0) or (r.own = 2 and s.role <> 2) or (r.own = 3 and s.role = 2)) then s.best.audit || 'K' end}],
    lambda w: w.audit is not null) as ways
  from states s join numbered r on r.conv_id is not distinct from s.conv_id and r.pos = s.pos + 1"""

CONVERSATIONS = f"""
with recursive {_CRC_TABLE},
ids as (select distinct conv_id from conversations),
keyed as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations),
hit as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
    {_crc("list_transform(string_split(k, ''), lambda x: unicode(x)::bigint)")} % 20 kind
  from keyed, crc_table),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text,
    unnest(case kind when 0 then [] when 3 then [1, 2] else [1] end) copy
  from hit),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) pos from damaged),
seen as (
  select *, row_number() over (partition by conv_id, role, text order by pos) > 1 again,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) body, lag(role[1]) over (partition by conv_id order by pos) || role[1] pair
  from placed),
faulty as (
  select *, case when body = '' then 'blank' when again then 'duplicate' when body[-1] not in ('.', '!', '?') then 'truncated' else '' end fault from seen),
numbered as (
  select conv_id, pos, role, text, fault in ('blank', 'duplicate') must, case when fault = 'truncated' then 5 else 0 end late,
    case role[1] when 's' then 1 when 'u' then 2 when 'a' then 3 else 9 end own
  from faulty),
states as (
  {_STEP.format(pos="0", more="", ways=_FIRST, by="conv_id, way.role")}
  union all {_STEP.format(pos="pos", more=", pos", ways=_WAYS, by="conv_id, pos, way.role")}),
ends as (select conv_id, max(pos) last from states group by conv_id),
chosen as (
  select s.conv_id, min(s.best) best from states s join ends e on s.conv_id is not distinct from e.conv_id and s.pos = e.last
  where s.role in (0, 3) group by s.conv_id),
edits as (select conv_id, best.audit audit, unnest(range(1, length(best.audit) + 1)) p from chosen),
placed_edits as (
  select conv_id, p, audit[p] edit, length(replace(audit[: p], 'I', '')) pos from edits),
kept as (
  select e.conv_id, e.p, e.edit, case when edit = 'I' then '' else r.text end text, case when edit = 'K' then r.role end own
  from placed_edits e left join numbered r on e.edit <> 'I' and r.pos = e.pos and r.conv_id is not distinct from e.conv_id
  where e.edit <> 'D'),
turns as (
  select *, row_number() over w - count(*) filter (where own[1] = 's') over w place from kept window w as (partition by conv_id order by p)),
lines as (select conv_id, p, coalesce(own, case when place % 2 = 1 then 'user' else 'assistant' end) || ':' || text line from turns),
texts as (select conv_id, string_agg(line, chr(10) order by p) whole from lines group by conv_id),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (where fault = 'blank') blank,
    count(*) filter (where fault = 'duplicate') duplicate, count(*) filter (where fault = 'truncated') truncated,
    count(*) filter (where pair not in ('su', 'ua', 'au')) illegal
  from faulty group by conv_id)
select i.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate,
  coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, c.best.cost::bigint cost, c.best.audit audit,
  sha256(coalesce(whole, '')) repaired_sha256
from ids i left join counts n on n.conv_id is not distinct from i.conv_id left join chosen c on c.conv_id is not distinct from i.conv_id
  left join texts x on x.conv_id is not distinct from i.conv_id"""


VECTORS = """
with recursive good as (
  select vec_id, embedding::double[] v from embeddings
  where vec_id is not null and not list_contains(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x)), true)
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id a, b.vec_id b from good a join good b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.95),
reach as (select vec_id node, vec_id far from good union select r.node, l.b from reach r join links l on r.far = l.a),
homes as (select node, min(far) root from reach group by node)
select e.vec_id, (select count(*) from links where a = e.vec_id) n_links, coalesce(root, e.vec_id) component_id,
  e.vec_id = coalesce(root, e.vec_id) kept
from embeddings e left join homes on node = e.vec_id"""
