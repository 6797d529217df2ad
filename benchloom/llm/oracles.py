"""DuckDB SQL for the operators that SQL can express; the others are tested against brute force.

``op8`` draws from 64-bit products that wrap, ``op1``, ``op2``, ``op4``, ``op7`` and ``op10`` need tokenizers, XXH64 or models, which SQL lacks;
``op6`` is approximate.
"""

WORD = r"[^\x20\x09-\x0D]+"

MIXING = f"""
with recursive d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) + 1 as n from documents),
t as (select source, cast(sum(n) as bigint) as tokens from d group by 1),
b as (select cast(sum(tokens) as bigint) as budget from t),
s as (select list(tokens / cast(budget as double) order by source nulls first) as p from t, b),
r as (select 0 as k, 0.0e0 as lo, 1.0e0 as hi, p from s
  union all
  select k + 1, case when up then mid else lo end, case when up then hi else mid end, p
  from (select *, ln(z) - mid * list_sum(list_transform(p, lambda x: pow(x, mid) * ln(x))) / z >= 0.97e0 * ln(len(p)) - 1e-12 as up
    from (select *, list_sum(list_transform(p, lambda x: pow(x, mid))) as z from (select *, (lo + hi) / 2 as mid from r where k < 40)))),
e as (select p, round(case when -list_sum(list_transform(p, lambda x: x * ln(x))) >= 0.97e0 * ln(len(p)) - 1e-12 then 1.0e0 else lo end, 9) as a from r where k = 40),
w as (select source, tokens, budget, cast(round(pow(tokens / cast(budget as double), a) / list_sum(list_transform(p, lambda x: pow(x, a))) * budget) as bigint) as allotted from t, b, e),
x as (select d.doc_id, d.source, d.n, w.tokens, w.allotted, w.budget, unnest(range((w.allotted - 1) // w.tokens + 1)) as epoch
  from d join w on d.source is not distinct from w.source where w.allotted > 0),
y as (select *, cast(concat('0x', substr(md5(concat('42:', epoch, ':', coalesce(cast(doc_id as varchar), 'null'))), 1, 15)) as bigint) as draw from x),
z as (select *, epoch * tokens + coalesce(sum(n) over (partition by source, epoch order by draw, doc_id, n rows between unbounded preceding and 1 preceding), 0) as place from y)
select doc_id, source, cast(epoch as int) as epoch, cast(floor(cast(place as double) * greatest(budget // 65536, 1) / allotted) as bigint) as block, draw, n as n_tokens
from z where place < allotted"""

P_STABLE = """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
c as (select vec_id, vec_id as root from v union select l.b, c.root from c join l on c.vec_id = l.a),
m as (select vec_id, min(root) as component_id from c group by 1), n as (select a, count(*) as n_links from l group by 1)
select m.vec_id, coalesce(n_links, 0) as n_links, component_id, m.vec_id = component_id as kept from m left join n on n.a = m.vec_id"""

WARC = """
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select h, max(page_id) as top from p where strlen(h) >= 1000 group by 1),
r as (select p.page_id, p.h, case when g.top <> p.page_id then g.top end as refers_to from p left join g on g.h = p.h)
select page_id, strlen(h) as payload_bytes, sha1(h) as payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to from r"""

PASSAGES = f"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) as w from documents),
p as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as k from (select *, unnest(range(1, len(w) - 11)) as i from d)),
m as (select k, min(doc_id) as least from g group by 1),
b as (select distinct doc_id, i + o as i from (select g.doc_id, g.i, unnest(range(13)) as o from g join m using (k) where m.least < g.doc_id)),
t as (select p.doc_id, string_agg(word, ' ' order by p.i) as kept, count(*) as n from p anti join b on p.doc_id = b.doc_id and p.i = b.i group by 1)
select d.doc_id, len(w) as n_words, len(w) - coalesce(t.n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join t using (doc_id)"""

#: The byte table of the CRC-32 with the reversed polynomial, and the CRC of a text expression.
CRC_TABLE = """r as (select 0 as k, unnest(range(256)) as n, n as c
  union all select k + 1, n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from r where k < 8),
crc as (select list(c order by n) as byte from r where k = 8)"""


def _crc32(text: str) -> str:
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: cast(concat('0x', substr(hex(encode({text})), 2 * i - 1, 2)) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, x: xor(c >> 8, byte[(xor(c, x) & 255) + 1])), 4294967295)"


RUNS = f"""
with recursive {CRC_TABLE},
a as (select doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) as w, {_crc32("cast(doc_id as varchar)")} as h from documents, crc),
o as (select doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as planted, case when len(w) > 0 then (h // 10) % len(w) end as a, h // 10 as g from a),
d as (select doc_id, case when planted then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else w end as w from o),
x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as i, len(w) as n from d),
e as (select l.doc_id, l.i, r.i - l.i as q from x l join x r on l.doc_id = r.doc_id and l.word = r.word and r.i > l.i and 4 * (r.i - l.i) <= l.n),
s as (select doc_id, q, i - row_number() over (partition by doc_id, q order by i) as grp, i from e),
c as (select doc_id, q as period, min(i) as start, count(*) + q as length from s group by doc_id, q, grp having count(*) + q >= greatest(6, 4 * q)),
u as (select doc_id, start, length, min(period) as period from c group by all),
t as (select doc_id, count(*) as n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as listed,
  first(struct_pack(start := start, length := length, period := period) order by length desc, start, period) as best from u group by 1),
k as (select doc_id, string_agg(word, ' ' order by i) as kept
  from x where not exists (select 1 from u where u.doc_id = x.doc_id and x.i >= u.start + u.period and x.i < u.start + u.length) group by 1)
select d.doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, best.length as length, best.period as period, 1000 * best.length // best.period as exponent_milli,
  sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256 from d left join t using (doc_id) left join k using (doc_id)"""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _features(table: str) -> str:
    return f"coalesce(regexp_extract_all(translate({table}.text, '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"


DRAW = f"""
with recursive {CRC_TABLE},
d as (select doc_id, {_features("documents")} as w from documents),
f as (select doc_id, unnest(w) as word from d), b as (select unnest({_features("benchmark")}) as word from benchmark),
k as (select word, {_crc32("word")} % 10000 as bucket from (select word from f union select word from b), crc),
s as (select bucket, count(*) as s from f join k using (word) group by 1), t as (select bucket, count(*) as t from b join k using (word) group by 1),
n as (select (select count(*) from f) as all_s, (select count(*) from b) as all_t),
g as (select bucket, cast(floor(1000.0e0 * ln((coalesce(t, 0) + 1.0e0) * (all_s + 10000.0e0) / ((s + 1.0e0) * (all_t + 10000.0e0)))) as bigint) as gain from s left join t using (bucket), n),
v as (select doc_id, sum(gain) as weight from f join k using (word) join g using (bucket) group by 1),
h as (select doc_id, len(w) as n_features, cast(coalesce(weight, 0) as bigint) as weight, cast(concat('0x', substr(sha256(concat('2024:', doc_id)), 1, 8)) as bigint) as h from d left join v using (doc_id)),
z as (select doc_id, n_features, weight, weight + cast(floor(-1000.0e0 * ln(-ln((h + 0.5e0) / 4294967296.0e0))) as bigint) as score from h),
o as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as fit from z where n_features >= 20)
select z.*, case when place <= 10 * fit // 100 then place end as rank from z left join o using (doc_id)"""

ORACLE = {
    "op3_mixing": MIXING,
    "op5_pstable_dedup": P_STABLE,
    "op9_warc": WARC,
    "op11_difference_cover": PASSAGES,
    "op12_word_runs": RUNS,
    "op13_prefix_crc": DRAW,
}
