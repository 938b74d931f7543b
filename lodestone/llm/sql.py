"""DuckDB SQL for the corpus queries that SQL can express."""

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SPACED = r"'[^\x20\x09-\x0D]+'"
PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NEAR_DUPLICATES = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), {SPACED}) w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end s from words
), flat as (
  select doc_id, len(s) n, unnest(s) g from sets
), links as (
  select a.doc_id x, b.doc_id y from flat a join flat b on a.g = b.g and a.doc_id <> b.doc_id
  group by all having 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach as (
  select doc_id, doc_id other from sets union select r.doc_id, l.y from reach r join links l on l.x = r.other
), least as (select doc_id, min(other) component_id from reach group by 1)
select s.doc_id, len(s.s)::bigint n_shingles, l.component_id, s.doc_id = l.component_id kept from sets s join least l using (doc_id)
"""

SUBSTRING_DUPLICATES = rf"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) w from documents
), windows as (
  select doc_id, p, array_to_string(list_slice(w, p, p + 34), ' ') s from (select doc_id, w, unnest(range(1, len(w) - 33)) p from words where len(w) >= 35)
), repeated as (
  select doc_id, p from windows where s in (select s from windows group by s having count(*) > 1)
), gone as (
  select distinct doc_id, p + k p from repeated, range(0, 35) r(k)
), lost as (select doc_id, list(p) gone from gone group by 1),
kept as (
  select doc_id, w, coalesce(gone, []) gone from words left join lost using (doc_id)
)
select doc_id, len(w)::bigint n_words, len(gone)::bigint n_removed,
  sha256(coalesce(array_to_string(case when len(gone) = 0 then w when len(gone) = len(w) then [] else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(gone, x[2])), lambda x: x[1]) end, ' '), '')) kept_sha256
from kept
"""

DECONTAMINATION = rf"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), {PLAIN}) w from documents
), items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), {PLAIN}) w from benchmark
), item_windows as (
  select distinct item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') s
  from (select item_id, w, least(len(w), 10) n, unnest(range(1, len(w) - least(len(w), 10) + 2)) p from items where len(w) > 0)
), sizes as (select distinct n from item_windows),
windows as (
  select doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) p from words, sizes where len(w) >= n)
), hits as (
  select doc_id, p, w.n, item_id from windows w join item_windows i on w.n = i.n and w.s = i.s
), hit_words as (
  select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from hits) group by 1
), hit_items as (
  select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) s from (select distinct doc_id, item_id from hits) group by 1
)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from words left join hit_words using (doc_id) left join hit_items using (doc_id)
"""
