"""SQL (DuckDB) for the numbered operators that SQL can express."""

PREFIX_TRIE = """
with recursive digits as (
  select distinct conv_id, list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint) as codes
  from conversations where conv_id is not null),
crcs as (
  select conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, codes),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 9 as h
  from digits),
turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
rebuilt as (
  select c.conv_id, t.pos as place, t.role, t.text from crcs c join turns t on t.conv_id = c.conv_id - c.conv_id % 5 and t.pos <= c.h
  union all
  select c.conv_id, t.pos, t.role, t.text from crcs c join turns t on t.conv_id = c.conv_id and t.pos > c.h),
paths as (
  select conv_id, text, row_number() over w as depth, count(*) over (partition by conv_id) as length, list(struct_pack(r := role, t := text)) over w as path
  from rebuilt window w as (partition by conv_id order by place rows between unbounded preceding and current row)),
members as (
  select conv_id, depth, path, strlen(text) as bytes, depth = length as is_end from paths
  union all
  select conv_id, 0, [], 0, conv_id not in (select conv_id from paths) from crcs),
nodes as (
  select min(conv_id) as conv_id, depth, path, any_value(bytes) as bytes, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where is_end), '')) as ends_sha256
  from members group by depth, path),
linked as (
  select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes c where c.depth = n.depth + 1 and c.path[1:n.depth] = n.path) as n_children
  from nodes n left join nodes p on p.depth = n.depth - 1 and p.path = n.path[1:p.depth])
select n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, n.ends_sha256,
  (count(*) filter (where b.n_children = 0))::bigint as n_leaves, sum((b.n_convs - 1) * b.bytes)::bigint as saved_tokens
from linked n join linked b on b.depth >= n.depth and (n.depth = 0 or b.path[1:n.depth] = n.path)
group by n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, n.ends_sha256
"""

RANKED_SEARCH = r"""
with doc_terms as (
  select row_number() over () as row_id, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
sized as (select row_id, doc_id, terms, len(terms) as n from doc_terms where len(terms) > 0),
whole as (select count(*) as docs, sum(n)::bigint as total from sized),
postings as (select row_id, term, count(*) as tf from (select row_id, unnest(terms) as term from sized) group by row_id, term),
weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w
  from (select term, count(*) as df from postings group by term), whole),
item_terms as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark) group by item_id, term),
scored as (
  select i.item_id, s.row_id, s.doc_id, sum(i.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * s.n * docs) // total))))::bigint as score
  from item_terms i join postings p using (term) join weights w using (term) join sized s using (row_id), whole
  group by i.item_id, s.row_id, s.doc_id),
ranked as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scored where score > 0)
select * from ranked where rank <= 10
"""
