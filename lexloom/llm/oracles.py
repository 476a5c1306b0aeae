"""DuckDB SQL of the queries that SQL can express; the others are held against brute force in the tests."""

from __future__ import annotations

from .license_scan import KNOWN
from .licenses import CONTAINS, RULES
from .mixing import FINE, GOLDEN

_W = r"[^\x20\x09-\x0D]+"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_BARE = r"regexp_replace(lower(text), '(^|\n)[ \t]*(dnl|rem)([ \t\r\n]|$)', '\1\3', 'g')"
_PARTED = rf"regexp_replace({_BARE}, '\n([^a-z0-9\n]*\n)+', '.' || chr(10), 'g')"
_PIECES = rf"string_split(regexp_replace(regexp_replace({_PARTED}, '([.!?:;])[ \t\r\f\v]+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10))"
OP1 = rf"""
with recursive known(sentence, ident) as (values {_values(KNOWN.items())}),
rules(n, rule, licence, pattern) as (values {_values((i, r, x, "(^|,)" + ",(.*,)?".join(y.replace(".", "[.]").replace("+", "[+]") for y in ids) + "(,|$)") for i, (r, x, ids) in enumerate(RULES))}),
contains(outer_, inner_) as (values {_values((x, y) for x, ys in CONTAINS.items() for y in ys)}),
docs as (select row_number() over () rid, * from documents),
raw as (select rid, unnest({_PIECES}) line, generate_subscripts({_PIECES}, 1) k from docs where text is not null),
said as (select rid, k, trim(regexp_replace(regexp_replace(line, '([0-9])[+]', '\1 or later ', 'g'), '[^a-z0-9]+', ' ', 'g')) piece, regexp_matches(line, '[.!?][ \t\r\f\v]*$') ended from raw),
pieces as (select rid, row_number() over (partition by rid order by k) pos, piece, ended from said where piece <> ''),
firsts as (select distinct split_part(sentence, ' ', 1) w from known),
run(rid, start, last, words, ended) as (
  select rid, pos, pos, piece, ended from pieces where split_part(piece, ' ', 1) in (select w from firsts)
  union all
  select r.rid, r.start, p.pos, r.words || ' ' || p.piece, p.ended from run r join pieces p on p.rid = r.rid and p.pos = r.last + 1
  where not r.ended and exists (select 1 from known k where starts_with(k.sentence, r.words || ' ' || p.piece))),
hits as (select rid, start, last, ident, row_number() over (partition by rid, start order by last desc) place from run join known on words = sentence),
seqs as (select rid, string_agg(ident, ',' order by start, last) ids, count(*) n from hits where place = 1 group by rid),
found as (select s.rid, r.n, r.rule, r.licence from seqs s join rules r on regexp_matches(s.ids, r.pattern)),
best as (select rid, min(n) n, arg_min(rule, n) rule, licence from found group by rid, licence),
outermost as (select * from best b where not exists (select 1 from best o join contains on outer_ = o.licence where o.rid = b.rid and inner_ = b.licence)),
per as (select rid, string_agg(rule, ',' order by n) rules, string_agg(licence, ',' order by n) licenses from outermost group by rid)
select doc_id, coalesce(s.n, 0)::bigint n_sentences, coalesce(s.ids, '') sentence_ids, coalesce(p.rules, '') rules, coalesce(p.licenses, '') licenses
from docs left join seqs s using (rid) left join per p using (rid)
"""

OP3 = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end s from words),
keyed as (select doc_id, len(s)::bigint n, md5(array_to_string(list_sort(s), chr(10))) k, s from sets),
reps as (select k, min(doc_id) rep, any_value(n) n, any_value(s) s from keyed where n > 0 group by k),
posts as (select rep, n, unnest(s) t from reps),
pairs as (select a.rep u, b.rep v from posts a join posts b on a.t = b.t and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges as (select u, v from pairs union all select v, u from pairs),
reach(a, b) as (select rep, rep from reps union select r.a, e.v from reach r join edges e on r.b = e.u),
roots as (select a rep, min(b) root from reach group by a)
select d.doc_id, d.n n_shingles, coalesce(o.root, d.doc_id) component_id, d.doc_id = coalesce(o.root, d.doc_id) kept
from keyed d left join reps r on d.k = r.k and d.n > 0 left join roots o on r.rep = o.rep
"""

OP4 = r"""
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages),
b as (select page_id, strlen(html) n, html, array_to_string(list_transform(string_split(h, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', c)]), '') bits from p),
f as (select *, min(page_id) over (partition by html) first from b)
select page_id, n::bigint payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::int + 8 * substr(bits, 5 * i + 2, 1)::int + 4 * substr(bits, 5 * i + 3, 1)::int + 2 * substr(bits, 5 * i + 4, 1)::int + substr(bits, 5 * i + 5, 1)::int, 1)), '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to
from f
"""

OP6 = rf"""
with d as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '{_W}'))::bigint size, case when source is null then '1' else '0' || source end s, md5(coalesce(doc_id::varchar, '')) h from documents),
src as (select s, sum(size)::bigint total, (row_number() over (order by s) - 1) % 3 + 1 w from d group by s),
ratio as (select *, 3 * total / w r from src),
levels as (select *, (sum(total) over () - coalesce(3 * sum(total) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) lv from ratio window b as (order by r, s rows between unbounded preceding and 1 preceding)),
target as (select s, total, least((3 * total)::double, (select arg_min(lv, (r, s)) from levels where lv <= r) * w) t from levels),
need as (select *, least(floor(t + 0.5)::bigint, 3 * total) need from target),
tier as (select *, length(to_hex(need)) tier from need where need > 0),
block as (select *, greatest(1, min(need) over g // {FINE}) b, sum(need) over g every, sum(need) over (partition by tier order by s rows unbounded preceding) upto from tier window g as (partition by tier)),
span as (select *, floor((upto - need) / every * 4294967296.0) lo, floor(upto / every * 4294967296.0) hi from block),
sizes as (select distinct tier, (2 * every + b) // (2 * b) n from block),
points as (select tier, i, (i * {GOLDEN}) % 4294967296 p from (select tier, unnest(range(n::bigint)) i from sizes)),
ranks as (select s, total, b, i, row_number() over (partition by s order by i) - 1 r, (total + b - 1) // b blocks from points p join span k on p.tier = k.tier and p.p >= k.lo and p.p < k.hi),
slots as (select s, r % blocks k, count(*) times, min(i) f, (r % blocks) * b a, least((r % blocks + 1) * b, total) z from ranks where r < 3 * blocks group by all),
pos as (select d.*, coalesce(sum(size) over (partition by s order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) a, row_number() over () rid from d),
got as (select p.rid, sum(times * (least(p.a + p.size, k.z) - greatest(p.a, k.a))) taken, arg_min(k.f, k.k) f from pos p join slots k on p.s = k.s and k.a < p.a + p.size and k.z > p.a where p.size > 0 group by p.rid)
select doc_id, size, total source_size, t target, coalesce(taken, 0)::bigint taken, g.f::bigint first_slot
from pos join need using (s) left join got g using (rid)
"""

OP8 = r"""
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) text_sha256 from documents)
select doc_id, min(doc_id) over g keep_id, count(*) over g group_size, coalesce(doc_id = min(doc_id) over g, min(doc_id) over g is null) kept, text_sha256
from n window g as (partition by text_sha256)
"""

OP10 = r"""
with recursive dw as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, least(13, len(w)) n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') g from bw, unnest(range(1, len(w) - least(13, len(w)) + 2)) t(i) where len(w) > 0),
sizes as (select distinct n from win),
grams as (select rid, n, i, array_to_string(w[i : i + n - 1], ' ') g from dw, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
occ as (select rid, n, i, item_id from grams join win using (n, g)),
hit as (select rid, count(distinct i + k) n_hit from occ, unnest(range(n)) t(k) group by rid),
items as (select rid, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from occ group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from dw left join hit using (rid) left join items using (rid)
"""

ORACLES = {"op1_license_scan": OP1, "op3_minhash_dedup": OP3, "op4_warc_zip": OP4, "op6_mixing": OP6, "op8_exact_dedup": OP8, "op10_decontaminate": OP10}
