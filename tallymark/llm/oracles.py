"""SQL for DuckDB that gives the rows of the queries it can express, from their definitions."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# All pairs of documents that share a shingle; reachability by recursion.
NEAR_DUPLICATES = f"""
with recursive docs as (
    select doc_id, row_number() over () as rid, {_WORDS.replace('text', _LOWER)} as w from documents
), shingles as (
    select distinct rid, unnest(case when len(w) >= 4
        then list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingle
    from docs
), sizes as (select rid, count(*) as n from shingles group by rid),
links as (
    select a.rid as a, b.rid as b from shingles a join shingles b on a.shingle = b.shingle and a.rid <> b.rid
    join sizes x on x.rid = a.rid join sizes y on y.rid = b.rid
    group by a.rid, b.rid, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach as (
    select rid, rid as r from docs union select reach.rid, links.b from reach join links on reach.r = links.a
), least as (select reach.rid, min(d.doc_id) as component_id from reach join docs d on d.rid = reach.r group by reach.rid)
select doc_id, coalesce(n, 0) as n_shingles, component_id
from docs join least using (rid) left join sizes using (rid)
"""

# The digest in base 32: five bits at a time from the hexadecimal one.
WARC = """
with rows as (
    select page_id, coalesce(html, '') as html, min(page_id) over (partition by coalesce(html, '')) as first from pages
), digests as (select page_id, strlen(html) as payload_bytes, first, sha1(html) as hex from rows)
select page_id, payload_bytes,
    (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
        (('0x' || substr(hex, 1 + (i * 5) // 4, 1))::int * 16
            + coalesce(('0x' || nullif(substr(hex, 2 + (i * 5) // 4, 1), ''))::int, 0))
        >> (3 - (i * 5) % 4)) % 32, 1), '' order by i) from range(32) r(i)) as payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type,
    case when page_id <> first then first end as refers_to
from digests
"""

# Every item-sized window that begins at a shared shingle or lies around it as the item would, compared exactly.
LEAKS = r"""
with docs as (
    select doc_id, row_number() over () as rid,
        list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w
    from documents
), items as (
    select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w
    from benchmark
), runs as (
    select rid, unnest(range(1, len(w) - 3)) as pos, unnest(list_transform(range(1, len(w) - 3),
        lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) as shingle
    from docs
), parts as (
    select item_id, len(w) as size, unnest(range(1, len(w) - 3)) as place, unnest(list_transform(range(1, len(w) - 3),
        lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) as shingle
    from items
), starts as (
    select distinct doc_id, rid, item_id, size, w, greatest(least(first, len(w) - size), 0) as start
    from (select d.doc_id, d.rid, p.item_id, p.size, d.w, unnest([r.pos - p.place, r.pos - 1]) as first
        from runs r join parts p using (shingle) join docs d on d.rid = r.rid)
), numbered as (select *, row_number() over () as n from starts),
own as (
    select n, shingle, count(*) as k from (
        select n, unnest(list_transform(range(start + 1, least(start + size, len(w)) - 3),
            lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) as shingle from numbered)
    group by n, shingle
), wanted as (select item_id, shingle, count(*) as k from parts group by item_id, shingle),
shared as (
    select n, sum(least(o.k, w.k)) as k from numbered join own o using (n) join wanted w using (item_id, shingle) group by n
), compared as (
    select doc_id, item_id, start as first_word, size as n_words,
        cast(k as double) / (least(size, len(w) - start) - 4 + size - 4 - k) as similarity
    from numbered join shared using (n)
)
select doc_id, item_id, cast(first_word as integer) as first_word, cast(n_words as integer) as n_words, similarity
from (select *, row_number() over (partition by doc_id, item_id order by similarity desc, first_word) as best
    from compared where similarity >= 0.8) where best = 1
"""

SUBSTRINGS = f"""
with docs as (select doc_id, row_number() over () as rid, {_WORDS} as w from documents),
windows as (
    select rid, doc_id, unnest(range(1, len(w) - 48)) as pos,
        unnest(list_transform(range(1, len(w) - 48), lambda i: array_to_string(list_slice(w, i, i + 49), ' '))) as run
    from docs
), repeated as (
    select rid, pos from (select *, min(doc_id) over (partition by run) as first from windows) where first < doc_id
), gone as (select distinct rid, pos + k as place from repeated, range(50) r(k)),
kept as (
    select p.rid, string_agg(p.word, ' ' order by p.place) as text, count(*) as n
    from (select rid, unnest(range(1, len(w) + 1)) as place, unnest(w) as word from docs) p
    left join gone g on g.rid = p.rid and g.place = p.place where g.rid is null group by p.rid
)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from docs left join kept using (rid)
"""

_MEASURES = {
    "symbols": ("1000 * n_symbols // greatest(word_chars, 1)", 60),
    "repeats": ("1000 * n_repeat_words // greatest(n_words, 1)", 300),
    "dup_lines": ("1000 * n_dup_lines // greatest(n_words, 1)", 100),
    "word_length": ("100 * word_chars // greatest(n_words, 1)", 200),
}


def _floor(v: str) -> str:
    shift = f"(length(bin({v})) - 5)"
    return f"case when {v} < 32 then {v} else ({v} >> {shift}) << {shift} end"


def _quartile(v: str, k: int) -> str:
    return f"list_sort(list({_floor(v)}))[cast(ceil({k} * count(*) / 4.0) as bigint)]"


def _outside() -> str:
    tests = []
    for name, (value, margin) in _MEASURES.items():
        reach = f"greatest(3 * ({name}_3 - {name}_1), {margin})"
        tests.append(f"{value} > {name}_3 + {reach}")
        if name == "word_length":
            tests.append(f"{value} < {name}_1 - {reach}")
    return " or ".join(tests)


_QUARTILES = ", ".join(f"{_quartile(f'({v})', k)} as {name}_{k}" for name, (v, _) in _MEASURES.items() for k in (1, 3))

RULES = rf"""
with docs as (
    select doc_id, lang, source, coalesce(text, '') as text, row_number() over () as rid, {_WORDS} as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
    from documents
), runs as (
    select rid, unnest(range(1, len(w) - 6)) as pos,
        unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' '))) as run
    from docs
), often as (select rid, pos from (select *, count(*) over (partition by rid, run) as k from runs) where k > 1),
repeats as (select rid, count(distinct pos + k) as n from often, range(8) r(k) group by rid),
measured as (
    select doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
        len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
    from docs left join repeats using (rid)
), limits as (select lang as l, source as s, {_QUARTILES} from measured where n_words > 0 group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
    not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not coalesce({_outside()}, false) as kept
from measured left join limits on lang is not distinct from l and source is not distinct from s
"""


SEARCH = rf"""
with terms as (
    select doc_id, rid, unnest(t) as term, len(t) as n from (
        select doc_id, row_number() over () as rid,
            regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
        from documents where text is not null)
), counted as (select doc_id, rid, term, n, count(*) as tf from terms group by doc_id, rid, term, n),
totals as (select count(*) as docs, cast(sum(n) as bigint) as length from (select distinct rid, n from terms)),
weighted as (
    select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w
    from counted, totals group by term, docs
), items as (
    select distinct item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark
), scored as (
    select item_id, doc_id, rid,
        cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) as bigint) as score
    from items join counted using (term) join weighted using (term), totals group by item_id, doc_id, rid
)
select item_id, cast(rank as integer) as rank, doc_id, score from (
    select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank
    from scored where score > 0)
where rank <= 10
"""


def _assigned(k: int) -> str:
    return f"""a{k} as materialized (
        select rid, c, d from (
            select rid, c, d, row_number() over (partition by rid order by d, c) as place from (
                select rid, c, cast(list_sum(list_transform(list_zip(p.v, q.v),
                    lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d
                from kept p, c{k} q))
        where place = 1)"""


def _moved(k: int) -> str:
    return f"""c{k} as materialized (
        select c, coalesce(mean, v) as v from c{k - 1} left join (
            select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as mean from (
                select c, i, sum(x) as s, count(*) as n from (
                    select c, unnest(v) as x, unnest(range(64)) as i from a{k - 1} join kept using (rid))
                group by c, i)
            group by c) using (c))"""


_ROUNDS = ", ".join(f"{_assigned(k)}, {_moved(k + 1)}" for k in range(10))

CENTROIDS = f"""
with kept as materialized (
    select row_number() over () as rid, vec_id,
        list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
    from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), c0 as materialized (
    select c, v from (select row_number() over (order by sha256('3:' || vec_id) nulls last, v) - 1 as c, v from kept)
    where c < 8
), {_ROUNDS}, {_assigned(10)}
select vec_id, cast(c as integer) as cluster, d as distance,
    cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
    sha256(array_to_string(centre, ',')) as centroid_sha256
from a10 join kept k using (rid) join (select c, v as centre from c10) using (c)
"""
