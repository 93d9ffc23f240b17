"""DuckDB twins of the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

URL_FILTERS = f"""
with urls as (
  select page_id,
    case when position('://' in coalesce(url, '')) > 0
         then substr(url, position('://' in url) + 3) else '' end as rest
  from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from urls),
rules(rhost, rpath, action) as (values
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hit as (
  select page_id, rhost || rpath as rule, action,
    row_number() over (partition by page_id order by length(rhost) + length(rpath) desc) as k
  from parts join rules
    on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select parts.page_id, host, path, rule, coalesce(action, 'allow') as verdict
from parts left join hit on hit.page_id = parts.page_id and k = 1
"""

SUBSTRINGS = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (
  select doc_id, s, array_to_string(ws[s:s + 19], ' ') as win
  from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as s from w)),
later as (
  select doc_id, s from (
    select doc_id, s, row_number() over (partition by win order by doc_id, s) as k from windows) where k > 1),
gone as (select distinct doc_id, s + i as p from later, (select unnest(range(20)) as i)),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
kept as (
  select doc_id, string_agg(word, ' ' order by p) as txt, count(*) as n
  from words anti join gone using (doc_id, p) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(txt, '')) as kept_sha256
from w left join kept using (doc_id)
"""

DECONTAMINATION = rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
wins as (
  select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') as win
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as s from i where len(ws) > 0)),
lens as (select distinct n from wins),
hit as (
  select distinct doc_id, s, w.n, item_id from (
    select doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) as s from d, lens where len(ws) >= n) x
  join wins w on w.n = x.n and w.win = array_to_string(ws[s:s + x.n - 1], ' ')),
covered as (
  select doc_id, count(distinct s + k) as n_hit from (
    select doc_id, s, unnest(range(n)) as k from (select distinct doc_id, s, n from hit)) group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (
    select distinct doc_id, item_id::varchar as item from hit) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  n_hit is not null as contaminated
from d left join covered using (doc_id) left join named using (doc_id)
"""

LICENSES = rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws, string_split(coalesce(text, ''), chr(10)) as ls from documents),
phrases(phrase, k, label) as (values ('gnu general public license', 4, 'gpl'), ('apache license', 2, 'apache'),
  ('cc by', 2, 'cc-by'), ('mit license', 2, 'mit')),
places as (
  select doc_id, s - 1 as s, label
  from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as s from d)
  join phrases on array_to_string(ws[s:s + k - 1], ' ') = phrase),
base as (
  select doc_id, count(*) as n_base, min(s) as first_word, max(s) as last_word,
    list_sort(list(distinct label)) as labels from places group by doc_id),
templates(label, t) as (values
  ('apache-2.0', 'licensed under the apache license version 2 0'),
  ('apache-2.0', 'licensed under the apache license version 2 0 the license you may not use this file except in ' ||
    'compliance with the license'),
  ('gpl-3.0', 'gnu general public license version 3'),
  ('gpl-2.0', 'gnu general public license version 2'),
  ('gpl-notice', 'this program is free software you can redistribute it and or modify it under the terms of the gnu ' ||
    'general public license as published by the free software foundation'),
  ('mit-notice', 'released under the mit license'),
  ('mit-notice', 'permission is hereby granted free of charge to any person obtaining a copy of this software and ' ||
    'associated documentation files'),
  ('cc-by-4.0', 'licensed under cc by 4 0'),
  ('cc-by-nc-4.0', 'licensed under cc by nc 4 0'),
  ('cc-by-sa-4.0', 'licensed under cc by sa 4 0'),
  ('bsd', 'redistribution and use in source and binary forms with or without modification are permitted'),
  ('mpl-2.0', 'this source code form is subject to the terms of the mozilla public license v 2 0')),
sets as (
  select label, len(string_split(t, ' ')) as size, list_distinct(string_split(t, ' ')) as t,
    ceil(0.9 * len(list_distinct(string_split(t, ' '))) - 1e-9) as least from templates),
hopeful as (select doc_id, ws, sets.* from d, sets where len(list_intersect(list_distinct(ws), t)) >= least),
blocks as (
  select doc_id, label, size, t, least, s, ws[s:s + size - 1] as b
  from (select *, unnest(range(1, greatest(len(ws) - size, 0) + 2)) as s from hopeful)),
fits as (
  select doc_id, label, t, s, s + size as e, len(list_intersect(list_distinct(b), t)) as overlap
  from blocks where len(list_intersect(list_distinct(b), t)) >= least),
held as (
  select doc_id, label, overlap / len(t) as share from fits f where not exists (
    select 1 from fits g where g.doc_id is not distinct from f.doc_id and g.s <= f.s and g.e >= f.e
      and len(g.t) > len(f.t) and list_has_all(g.t, f.t))),
more as (select doc_id, list(distinct label) as labels, max(share) as share from held group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
  coalesce(array_to_string(base.labels, ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []),
    coalesce(more.labels, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0 else coalesce(share, 0.0) end::double as score
from d left join base using (doc_id) left join more using (doc_id)
"""

HARD_NEGATIVES = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_dot_product(a.v, r.v)::bigint as score
  from rows a, rows r where a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id,
       (row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id))::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
  and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""

CONVERSATIONS = r"""
with recursive damaged as (
  select conv_id, turn, case when hit = 4 then 'user' else coalesce(role, ' ') end as role,
         case hit when 1 then '' when 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text,
         unnest(case hit when 0 then [] when 3 then [1, 2] else [1] end) as copy
  from (select *, crc % 20 as hit from (
    select *, list_reduce(list_prepend(4294967295::ubigint, list_transform(
      range(octet_length(encode(key))), lambda i: ascii(key[i + 1])::ubigint)), lambda c, b: list_reduce(
        list_prepend(xor(c, b), list_transform(range(8), lambda j: 0::ubigint)),
        lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)) as raw,
      xor(raw, 4294967295::ubigint) as crc
    from (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations)))),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
         rtrim(text, e' \t\n\x0b\x0c\r') as bare, role[1] as initial from damaged),
faulty as (
  select *, case when bare = '' then 'blank' when seen > 1 then 'duplicate'
                 when bare[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault,
         lag(initial) over (partition by conv_id order by i) as before from placed),
edits as (  -- state 0: nothing yet, 1: a system turn, 2: an open user turn, 3: an assistant turn last
  select * from (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) t(initial, state, following)),
fits as (select * from (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user'))
         t(state, following, role)),
states as (select state from fits),
inserts as (  -- up to two inserts from a state
  select state as a, state as b, 0 as cost, '' as audit, '' as made from states
  union all select state, following, 3, 'I', role || ':' || chr(10) from fits
  union all select f.state, g.following, 6, 'II', f.role || ':' || chr(10) || g.role || ':' || chr(10)
  from fits f join fits g on g.state = f.following),
paths as (
  select conv_id, 0::bigint as i, b as state, cost::bigint as cost, audit, made from
    (select distinct conv_id from damaged), inserts where a = 0
  union all
  select conv_id, i, state, cost, audit, made from (
    select *, row_number() over (partition by conv_id, state order by cost, audit) as place from (
      select p.conv_id, r.i, n.b as state, p.cost + e.cost + n.cost as cost, p.audit || e.letter || n.audit as audit,
             p.made || e.made || n.made as made
      from paths p join faulty r on r.conv_id is not distinct from p.conv_id and r.i = p.i + 1
      cross join lateral (
        select 'D' as letter, 4 as cost, p.state as following, '' as made
        union all select 'K', case when r.fault = 'truncated' then 3 else 0 end, k.following,
          r.role || ':' || r.text || chr(10)
          from edits k where k.state = p.state and k.initial = r.initial and r.fault not in ('blank', 'duplicate')
        union all select 'R', 3 + case when r.fault = 'truncated' then 3 else 0 end, f.following,
          f.role || ':' || r.text || chr(10)
          from fits f where f.state = p.state and r.fault not in ('blank', 'duplicate')) e
      join inserts n on n.a = e.following)) where place = 1),
ended as (
  select p.* from paths p join (select conv_id, max(i) as n from faulty group by conv_id) c
    on c.conv_id is not distinct from p.conv_id and c.n = p.i
  where p.state in (0, 3)
  qualify row_number() over (partition by p.conv_id order by cost, audit) = 1),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (i > 1 and before || initial not in ('su', 'ua', 'au')) as illegal
  from faulty group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost,
       coalesce(audit, '') as audit, sha256(coalesce(made[:-2], '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted c on c.conv_id is not distinct from o.conv_id
left join ended e on e.conv_id is not distinct from o.conv_id
"""
