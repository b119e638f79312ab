"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from navloom.llm import (alignment, decontaminate, exact_dedup, html_text, language_id, near_dedup, neighbours,
                         packing, personal_data, quality, resampling, token_counts, url_filter)
from navloom.llm.texts import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query(r"""
with d as (
  select doc_id, length(coalesce(text, '')) as points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
g as (
  select text_sha256, count(*) as group_size,
         arg_min(doc_id, (-points)::hugeint * 1000000000000000000 + doc_id) as keep_id
  from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
from d join g using (text_sha256)""")
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


@query()
def op2_url_filter(spark, sf_dir):
    return url_filter.verdicts(table(spark, sf_dir, "pages"))


@query(r"""
with w as (
  select doc_id as id, false as item, list_filter(list_transform(
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'),
    lambda x: regexp_replace(regexp_replace(x, '^[!-/:-@\[-`{-~]+', ''), '[!-/:-@\[-`{-~]+$', '')), lambda x: x <> '') as l
  from documents
  union all
  select item_id, true, list_filter(list_transform(
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'),
    lambda x: regexp_replace(regexp_replace(x, '^[!-/:-@\[-`{-~]+', ''), '[!-/:-@\[-`{-~]+$', '')), lambda x: x <> '')
  from benchmark),
u as (select id, item, l, len(l) as n, unnest(range(len(l))) as p from w),
v as (select id, item, n, p, l[p + 1] as a, l[p + 2] as b from u),
laid as (  -- a word pair in common, or the only word of an item
  select distinct d.id as doc_id, i.id as item_id, d.p - i.p as shift
  from v d join v i on d.a = i.a and (d.b = i.b or i.n = 1) and not d.item and i.item),
hit as (  -- the words that agree, place by place
  select laid.doc_id, laid.item_id, i.n as n_words, d.n as doc_words, laid.shift, d.p
  from laid join v i on i.item and i.id = laid.item_id
  join v d on not d.item and d.id = laid.doc_id and d.p = i.p + laid.shift and d.a = i.a),
whole as (
  select doc_id, item_id, n_words, count(*) as n, greatest(shift, 0) as first_word, least(shift + n_words, any_value(doc_words)) as end_word
  from hit group by doc_id, item_id, n_words, shift
  having count(*) * 100 >= n_words * case when n_words < 5 then 100 else 75 end),
placed as (  -- longer items that aren't there as a whole
  select *, row_number() over (partition by doc_id, item_id, shift order by p) as r
  from hit anti join whole using (doc_id, item_id) where n_words >= 5),
stretches as (
  select x.doc_id, x.item_id, x.n_words, x.shift, y.r - x.r + 1 as n, x.p as first_word, y.p + 1 as end_word
  from placed x join placed y using (doc_id, item_id, shift)
  where y.p - x.p + 1 >= least(13, x.n_words) and 100 * (y.r - x.r + 1) >= 75 * (y.p - x.p + 1)),
stretch as (
  select * from stretches
  qualify row_number() over (partition by doc_id, item_id, shift order by end_word - first_word desc, end_word) = 1),
open as (select * from placed anti join stretch using (doc_id, item_id)),
windows as (  -- four places of which three agree
  select doc_id, item_id, shift, t from (
    select distinct doc_id, item_id, shift, n_words, doc_words, p, unnest(range(p - 3, p + 1)) as t from open)
  where t >= greatest(shift, 0) and t + 4 <= least(shift + n_words, doc_words)
  group by doc_id, item_id, shift, t having count(*) >= 3),
piece as (
  select distinct o.doc_id, o.item_id, o.n_words, o.shift, o.p
  from open o join windows s using (doc_id, item_id, shift) where o.p between s.t and s.t + 3),
moved as (
  select c.doc_id, c.item_id, p.n_words, count(distinct p.p - p.shift) as n, min(p.p) as first_word, max(p.p) + 1 as end_word
  from (select distinct doc_id, item_id, shift from piece) c
  join piece p on p.doc_id = c.doc_id and p.item_id = c.item_id and p.shift between c.shift - 5 and c.shift + 5
  group by c.doc_id, c.item_id, p.n_words, c.shift having 100 * count(distinct p.p - p.shift) >= 75 * p.n_words),
every as (
  select doc_id, item_id, n_words, n, first_word, end_word from whole
  union all select doc_id, item_id, n_words, n, first_word, end_word from stretch
  union all select doc_id, item_id, n_words, n, first_word, end_word from moved)
select doc_id, item_id, n::int as n_matches, n_words::int as n_words, first_word::int as first_word,
       end_word::int as end_word, n / n_words as similarity
from every
qualify row_number() over (partition by doc_id, item_id order by n desc, first_word, end_word desc) = 1""")
def op3_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op4_html_text(spark, sf_dir):
    return html_text.main_texts(table(spark, sf_dir, "pages"))


@query()
def op5_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query()
def op6_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_language(spark, sf_dir):
    return language_id.languages(table(spark, sf_dir, "documents"))


@query(r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as l
  from documents),
s as (
  select doc_id, list_distinct(case when len(l) = 0 then [] when len(l) < 5 then [array_to_string(l, ' ')]
    else list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) end) as set_
  from w),
x as (select doc_id, len(set_) as n, unnest(set_) as shingle from s),
links as (
  select a.doc_id as a, b.doc_id as b
  from x a join x b on a.shingle = b.shingle and a.doc_id <> b.doc_id and 100 * b.n >= 75 * a.n and 100 * a.n >= 75 * b.n
  group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
near as (select a, least(a, min(b)) as m from links group by a),
reach as (
  select a as node, m as root from near
  union
  select l.b, r.root from reach r join links l on l.a = r.node where r.root < l.b)
select s.doc_id, len(s.set_)::bigint as n_shingles, least(s.doc_id, coalesce(min(r.root), s.doc_id)) as component_id,
       s.doc_id = least(s.doc_id, coalesce(min(r.root), s.doc_id)) as kept
from s left join reach r on r.node = s.doc_id
group by s.doc_id, s.set_""")
def op8_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


@query()
def op9_personal_data(spark, sf_dir):
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


@query()
def op10_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query(r"""
with steps as (  -- the 256 steps of crc32
  select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i:
    case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as step),
w as (
  select doc_id, false as target, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as l from documents
  union all
  select item_id, true, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
f as (select doc_id, target, unnest(l) as word from w),
bytes as (
  select word, list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::bigint) as b
  from (select distinct word, hex(encode(word)) as x from f)),
buckets as (
  select word, xor(list_reduce(list_concat([4294967295], b), lambda c, y: xor(step[(xor(c, y) & 255) + 1], c >> 8)),
                   4294967295) % 10000 as bucket
  from bytes, steps),
counts as (
  select bucket, count(*) filter (not target) as s, count(*) filter (target) as t from f join buckets using (word)
  group by bucket),
gain as (
  select bucket, floor(1000 * ln(((t + 1) * (sum(s) over () + 10000))::double
                                 / ((s + 1) * (sum(t) over () + 10000))::double))::bigint as gain
  from counts),
d as (select f.doc_id, sum(gain) as weight from f join buckets using (word) join gain using (bucket)
      where not target group by f.doc_id),
scored as (
  select w.doc_id, len(w.l)::bigint as n_features, coalesce(d.weight, 0)::bigint as weight,
         (coalesce(d.weight, 0) + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('2024:' || w.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score
  from w left join d using (doc_id) where not w.target),
drawn as (
  select doc_id, row_number() over (order by score desc, doc_id) as k, count(*) over () as n
  from scored where n_features >= 20)
select scored.*, case when k <= n * 10 // 100 then k end as rank from scored left join drawn using (doc_id)""")
def op11_resampling(spark, sf_dir):
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_nearest(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query()
def op13_alignment(spark, sf_dir):
    return alignment.alignment(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                               vocabulary("piece_bpe_32k.model"))
