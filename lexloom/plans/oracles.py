"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from ..functions import dictionaries as dic
from ..functions import predicates as p
from ..functions import text as tx
from ..functions.dialect import Duck
from ..operators import tagging, web

ORACLES = {}


def words(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


_PUNCT = r"""[’!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
NGRAM_NORMAL = rf"trim(regexp_replace(regexp_replace(lower(text), '{_PUNCT}', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
TOKENS = f"list_filter(regexp_extract_all({NGRAM_NORMAL}, '{tx.FRENCH_TOKEN}'), lambda t: length(t) >= 2 and t not in ({words(dic.NGRAM_STOPWORDS)}))"


def _ngrams(source: str, by: str, sizes: str, top: int) -> str:
    return f"""
with t as (select {by}, {TOKENS} w from {source}),
g as (select {by}, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) ngram from t, (values {sizes}) s(n) where len(w) >= n),
k as (select {by}, n, ngram, count(*) "count" from g group by all having count(*) >= 2)
select {by}, n, ngram, "count" from k qualify row_number() over (partition by {by}, n order by "count" desc, ngram) <= {top}
"""


ORACLES["ngrams_top"] = _ngrams("documents", "lang", "(2), (3)", 200)
ORACLES["ngrams_by_role"] = _ngrams("conversations", "role", "(2)", 50)
ORACLES["word_freq"] = rf"""
select strip_accents(w) mot, count(*) occurrences from (select unnest(regexp_extract_all(lower(text), '\p{{L}}+')) w from documents) where w not in ({words(dic.NGRAM_STOPWORDS)}) group by 1
"""
ORACLES["cloud_weights"] = rf"""
with k as (select w mot, count(*) occurrences from (select unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) w from documents) where length(w) >= 4 and w not in ({words(dic.NGRAM_STOPWORDS)}) and not regexp_full_match(w, '\p{{N}}+') group by 1
  order by 2 desc, 1 limit 200)
select mot, occurrences, occurrences / max(occurrences) over () weight from k
"""
_S = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(31), 'g'), '\n+', chr(31), 'g'), chr(31)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))), lambda s: length(s) >= 2)"
SENTENCES = f"select doc_id, unnest(range(len(s)))::int pos, unnest(s) sentence from (select doc_id, {_S} s from documents)"
ORACLES["sentence_split"] = SENTENCES
ORACLES["block_chunks"] = r"""
with d as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: length(s) >= 200) ps from documents),
c as (select doc_id, case when len(ps) >= 3 then ps else list_filter(list_transform(range(greatest(0, (length(text) - 1) // 1200) + 1), lambda i: trim(substr(text, i * 1200 + 1, 1200), ' ' || chr(9) || chr(10) || chr(13))), lambda s: length(s) >= 200) end c from d)
select doc_id, unnest(range(len(c)))::int pos, unnest(c) chunk from c
"""
ORACLES["line_dedup"] = r"""
with l as (select doc_id, unnest(range(len(s)))::int pos, unnest(s) line from (select doc_id, string_split(text, chr(10)) s from documents))
select doc_id, min(pos) pos, line from l where not regexp_full_match(line, '[ \t\r\f\x0B]*') group by doc_id, line
"""
ORACLES["text_dedup"] = f"select doc_id, text from documents qualify row_number() over (partition by lower({tx.squeeze(Duck, 'text')}) order by doc_id) = 1"
ORACLES["idea_dedup"] = f"""
with s as ({SENTENCES}), i as (select doc_id, pos, {tx.idea(Duck, 'sentence')} idea from s), k as (select *, {tx.idea_key(Duck, 'idea')} as "key" from i)
select doc_id, pos, "key", idea from k where "key" <> '' qualify row_number() over (partition by doc_id, "key" order by pos) = 1
"""
_TAGS: dict[tuple[int, str], list[str]] = {}
for _o, _t, _w, _j in sorted(dic.TAGS, key=lambda r: (r[0], r[3])):
    _TAGS.setdefault((_o, _t), []).append(_w)


def _tagged(of) -> str:
    cases = (f"case {' '.join(f'when contains(phrase, {Duck.lit(w)}) then {Duck.lit(of(t, w))}' for w in ws)} end" for (_, t), ws in _TAGS.items())
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x is not null), ';')"


_LINES = f"select doc_id, pos, {tx.ascii_fold(Duck, 'line')} phrase from (select doc_id, unnest(range(len(s)))::int pos, unnest(s) line from (select doc_id, string_split(text, chr(10)) s from documents))"
_TAG_LINES = f"select doc_id, pos, phrase, {_tagged(lambda t, w: t)} tags, {_tagged(lambda t, w: w)} motcle from ({_LINES}) where phrase <> ''"
ORACLES["tag_lines"] = _TAG_LINES
ORACLES["tag_counts"] = f"""
with t as ({_TAG_LINES}), e as (select unnest(string_split(tags, ';')) tag from t where tags <> '' union all select '(all)' from t union all select '(untagged)' from t where tags = '')
select tag, count(*) "count" from e group by tag
"""
_WORDS = lambda kws: "array_to_string(list_filter([" + ", ".join(f"case when {tagging.keyword_hits(Duck, 'rewritten', [k])} = 1 then {Duck.lit(k)} end" for k in kws) + "], lambda x: x is not null), ',')"  # noqa: E731
_HITS = " union all ".join(f"select doc_id, pos, {Duck.lit(i)} id, {Duck.lit(label)} label, {tagging.keyword_hits(Duck, 'rewritten', kws)} s, {_WORDS(kws)} kws from n" for _, i, label, kws in dic.ONTOLOGY)
_ONTOLOGY = f"""
with b as ({SENTENCES}), m as (select doc_id, pos, {tx.ontology_normal(Duck, 'sentence')} normalized from b), n as (select *, {tagging.synonyms('normalized', dic.SYNONYMS, Duck)} rewritten from m),
h as (select * from ({_HITS}) where s >= 1),
a as (select doc_id, pos, string_agg(id, ';' order by s desc, label, id) ids, string_agg(s::varchar, ';' order by s desc, label, id) ss, string_agg(label, ';' order by s desc, label, id) ls, string_agg(kws, ';' order by s desc, label, id) ks, arg_min(id, (-s, label, id)) dom, max(s) best from h group by all)
"""
ORACLES["ontology_sentences"] = _ONTOLOGY + """
select n.doc_id, n.pos, normalized, rewritten, coalesce(ids, 'unclassified') all_categories, coalesce(ss, '0') all_scores, coalesce(ls, 'Unclassified') all_labels, coalesce(ks, '') all_keywords, coalesce(dom, 'unclassified') dominant, coalesce(best, 0) dominant_score from n left join a using (doc_id, pos)
"""
ORACLES["ontology_single"] = _ONTOLOGY + """
, d as (select doc_id, pos, arg_min(id, (-s, label, id)) dom, arg_min(label, (-s, label, id)) label, arg_min(kws, (-s, label, id)) kws, max(s) best from h group by all)
select n.doc_id, n.pos, coalesce(dom, 'unclassified') all_categories, coalesce(best, 0)::varchar all_scores, coalesce(label, 'Unclassified') all_labels, coalesce(kws, '') all_keywords, coalesce(dom, 'unclassified') dominant, coalesce(best, 0) dominant_score from n left join d using (doc_id, pos) where n.pos < 5
"""
ORACLES["ontology_stats"] = _ONTOLOGY + f""", c as (select id, count(*) n from h group by id union all select 'unclassified', (select count(*) from n) - (select count(*) from a)), t as (select count(*) n from b)
select category_id, category_label, coalesce(c.n, 0)::bigint occurrences, coalesce(c.n, 0) / t.n share from (values {', '.join(f"('{i}', '{x}')" for _, i, x, _ in dic.ONTOLOGY)}, ('unclassified', 'Unclassified')) d(category_id, category_label) left join c on c.id = category_id, t
"""
ORACLES["sentence_flags"] = f"with s as ({SENTENCES}) select doc_id, pos, {', '.join(f'{f(Duck, chr(34) + 'sentence' + chr(34))} as {n}' for n, f in p.FLAGS.items())} from s"
ORACLES["numeric_score"] = f"with s as ({SENTENCES}) select doc_id, pos, {p.score(Duck, 'sentence')} score, {p.alpha_words(Duck, 'sentence')} n_words, {p.digits(Duck, 'sentence')} n_digits from s where {p.number(Duck, 'sentence')}"
ORACLES["numeric_best"] = f"""
with s as ({SENTENCES}), k as (select doc_id, pos, sentence, {p.score(Duck, 'sentence')} score, {tx.numeric_key(Duck, 'sentence')} "key" from s where {p.number(Duck, 'sentence')}),
b as (select doc_id, "key", min(pos) pos, arg_min(sentence, (-score, -length(sentence), pos)) sentence, max(score) score from k where score >= 1 group by all)
select doc_id, pos, sentence, score from b qualify row_number() over (partition by doc_id order by pos) <= 400
"""
_HREFS = r"""select page_id, url, unnest(range(len(h)))::int pos, unnest(h) href from (select page_id, url, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) h from pages)"""
_LINKS = f"""
with h as ({_HREFS}), r as (select page_id, url, pos, {tx.url_normal(Duck, '(' + web.resolved(Duck, 'url', 'href') + ')')} link from h),
l as (select page_id, url, link, min(pos) pos from r where starts_with(link, 'http') group by all), c as (select page_id, pos, link, {web.link_class(Duck, 'link', 'url')} "class" from l)
"""
ORACLES["page_links"] = _LINKS + 'select page_id, pos, link, "class" from c'
ORACLES["link_classes"] = _LINKS + 'select "class", count(*) n, count(distinct link) n_links from c group by 1'
ORACLES["page_names"] = f"select page_id, {tx.url_normal(Duck, 'url')} normal, {tx.domain(Duck, 'url')} as domain, {tx.url_filename(Duck, 'url')} file, {tx.year_in(Duck, 'url')} as year, {tx.video_id(Duck, 'url')} video from pages"
ORACLES["page_features"] = f"""
with f as (select page_id, {web.news_score(Duck, 'html')} score, {web.page_year(Duck, 'html', 'url')} as year, {Duck.match('html', web.ANTIBOT)} blocked from pages)
select page_id, score, score >= 3 is_news, year, blocked from f
"""
ORACLES["journal_unseen"] = f"select page_id, url from pages where url not in (select url from pages where {Duck.match('url', web.PAGING)})"
ORACLES["crawl_frontier"] = _LINKS.replace("with h", "with recursive h", 1) + f""", pg as (select page_id, {tx.domain(Duck, 'url')} url, length(url) k from pages),
e as (select pg.url, {tx.domain(Duck, 'c.link')} link from pg join c using (page_id) union select url, lag(url) over (partition by k order by page_id) from pg),
w(url, depth) as (select min(url), 0 from pg union select e.link, depth + 1 from w join e using (url) where depth < 40 and e.link is not null)
select url, min(depth) depth from w group by url
"""
ORACLES["concat_by_source"] = """
with j as (select conv_id, string_agg(text, chr(10) || repeat('=', 50) || chr(10) order by turn, text) joined from conversations group by conv_id)
select conv_id, length(joined) n_chars, md5(joined) md5 from j
"""
#: Greedy folds as recursive queries, one step a line; ``src`` has id, i (from 1), line and n (its size).
_LINES_OF = "select doc_id id, unnest(range(1, len(s) + 1)) i, unnest(s) line from (select doc_id, string_split(text, chr(10)) s from documents)"


def _greedy(src: str, most: int, piece: str, pieces: str) -> str:
    """Packing with a flush before a line that doesn't fit; a line over ``most`` is cut by itself, by ``piece`` k of ``pieces``."""
    return f"""
with recursive src as ({src}),
f(id, i, g, size) as (
  select id, i, 1, case when n > {most} then null else n end from src where i = 1
  union all
  select s.id, s.i, f.g + case when s.n > {most} or f.size is null or f.size + s.n > {most} then 1 else 0 end, case when s.n > {most} then null when f.size is null or f.size + s.n > {most} then s.n else f.size + s.n end
  from f join src s on s.id = f.id and s.i = f.i + 1),
g as (select id, g, max(n) n, string_agg(line, chr(10) || chr(10) order by i) t, any_value(line) line from f join src using (id, i) group by id, g),
c as (select id, g, case when n > {most} then list_transform(range({pieces}), lambda k: {piece}) else [t] end ts from g)
select id doc_id, (row_number() over (partition by id order by g, k) - 1)::int pos, chunk from (select id, g, unnest(range(len(ts))) k, unnest(ts) chunk from c)
"""


_COUNT = r"len(regexp_extract_all(line, '[^ \t\n\r\f\v]+'))"
ORACLES["chunk_words"] = _greedy(f"select *, {_COUNT} n from ({_LINES_OF})", 120, r"array_to_string(regexp_extract_all(line, '[^ \t\n\r\f\v]+')[k * 120 + 1 : k * 120 + 120], ' ')", "(n + 119) // 120")


def _chars(most: int) -> str:
    """Packing by characters, two more a line; a line's own length, without these, tells whether it is cut."""
    sql = _greedy(f"select *, length(line) + 2 n from ({_LINES_OF})", most, f"substr(line, k * {most} + 1, {most})", f"(n - 2 + {most - 1}) // {most}")
    for over in (f"n > {most} then null", f"s.n > {most} or", f"when s.n > {most}", f"case when n > {most}"):
        sql = sql.replace(over, over.replace("n >", "n - 2 >"))
    return sql


ORACLES["chunk_chars"] = _chars(700)


def _packed_lines(src: str, most: int, least: int) -> str:
    """T15 over ``src`` (id, part, i, line): parts are packed by themselves; gives id, part, h, chunk."""
    return rf"""
src as (select id, part, row_number() over (partition by id, part order by i) i, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) line from ({src}) where not regexp_full_match(line, '[ 	
]*')),
sized as (select *, len(regexp_extract_all(line, '[\p{{L}}\p{{N}}_]+')) n from src),
f(id, part, i, g, size) as (select id, part, i, 1, n from sized where i = 1 union all
  select s.id, s.part, s.i, f.g + case when f.size + s.n > {most} then 1 else 0 end, case when f.size + s.n > {most} then s.n else f.size + s.n end from f join sized s on s.id = f.id and s.part = f.part and s.i = f.i + 1),
firsts as (select id, part, g, string_agg(line, chr(10) order by i) t, sum(n) n from f join sized using (id, part, i) group by id, part, g),
m(id, part, g, h, size) as (select id, part, g, 1, n from firsts where g = 1 union all
  select s.id, s.part, s.g, m.h + case when m.size < {least} then 0 else 1 end, case when m.size < {least} then m.size + s.n else s.n end from m join firsts s on s.id = m.id and s.part = m.part and s.g = m.g + 1),
packed as (select id, part, h, string_agg(t, chr(10) order by g) chunk from m join firsts using (id, part, g) group by id, part, h)
"""


ORACLES["chunk_lines"] = f"with recursive {_packed_lines(f'select *, 0 part from ({_LINES_OF})', 160, 60)} select id doc_id, (h - 1)::int pos, chunk from packed"
ORACLES["size_parts"] = f"""
with recursive src as ({_LINES_OF}), f(id, i, g, size) as (select id, i, 1, length(line) + 1 from src where i = 1 union all
  select s.id, s.i, f.g + case when f.size >= 2000 then 1 else 0 end, case when f.size >= 2000 then 0 else f.size end + length(s.line) + 1 from f join src s on s.id = f.id and s.i = f.i + 1)
select id doc_id, (g - 1)::int pos, string_agg(line || chr(10), '' order by i) part from f join src using (id, i) group by id, g
"""
_OFF = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '!\[[^]]*\][(][^)]*[)]', '', 'g'), '\[([^]]+)\][(][^)]*[)]', '\1', 'g'), '\*\*([^*]+)\*\*|__([^_]+)__', '\1\2', 'g'), '\*([^*]+)\*', '\1', 'g'), '`([^`]+)`', '\1', 'g')"
_MARKDOWN = rf"""
m0 as (select doc_id, list_filter(list_transform(range(len(s)), lambda i: case when i = 0 then '# ' || s[1] when i % 12 = 5 then '## Abstract' when i % 4 = 1 then '## ' || s[i + 1] when i % 4 = 3 then '### ' || s[i + 1] else s[i + 1] end),
  lambda x: not regexp_matches(x, '^\s*\|?[\s:|-]*-{{3,}}[\s:|-]*$')) ls from (select doc_id, string_split(text, chr(10)) s from documents)),
m1 as (select doc_id, (unnest(range(len(ls))))::int pos, unnest(list_transform(ls, lambda s: case when regexp_matches(s, '^\s*#{{1,6}}\s') then s else {_OFF} end)) raw from m0),
m2 as (select doc_id, pos, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) line from m1),
m3 as (select *, length(regexp_extract(line, '^(#{{1,6}})\s+\S', 1)) lv, trim(regexp_replace(line, '^#{{1,6}}\s+', ''), ' ' || chr(9)) name from m2 where line <> ''),
m4 as (select *, sum(case when lv > 0 then 1 else 0 end) over w heads from m3 window w as (partition by doc_id order by pos)),
m5 as (select *, case when lv > 0 and heads = 1 then 'title' when lv > 0 and lower(name) in ('abstract', 'résumé', 'summary') then 'abstract' when lv between 1 and 2 then 'section' when lv > 0 then 'sub' end own from m4),
m6 as (select *, last_value(own ignore nulls) over w kind, first_value(case when lv > 0 then name end ignore nulls) over w title, sum(case when own = 'section' then 1 else 0 end) over w sec,
  coalesce(last_value(case when own = 'section' then name end ignore nulls) over w, 'Untitled section') section from m5 window w as (partition by doc_id order by pos)),
headed as (select *, sum(case when own = 'sub' then 1 else 0 end) over w sub, last_value(case when own = 'sub' then name end ignore nulls) over w subsection from m6 window w as (partition by doc_id, sec order by pos))
"""
ORACLES["markdown_sections"] = f"""
with {_MARKDOWN} select doc_id, pos, title, case when kind = 'abstract' then 'Abstract' else section end section, case when kind = 'sub' then subsection end subsection, kind = 'abstract' is_abstract, line
from headed where lv = 0 and kind in ('abstract', 'section', 'sub')
"""
ORACLES["doc_plans"] = f"""
with {_MARKDOWN}, numbered as (select *, dense_rank() over (partition by doc_id order by sec) n from headed where lv > 0 and kind in ('section', 'sub')),
told as (select doc_id, pos, case when kind = 'section' then n || '. ' || name else case when sec = 0 and sub = 1 then n || '. ' || section || chr(10) else '' end || '   ' || n || '.' || sub || ' ' || name end x from numbered),
plan as (select doc_id, string_agg(x, chr(10) order by pos) x from told group by doc_id),
facts as (select doc_id, max(title) title, max(case when kind = 'abstract' and lv = 0 then 1 else 0 end) abstract from headed group by doc_id)
select doc_id, title, trim(concat_ws(chr(10), 'TITLE: ' || title, case when abstract = 1 then 'ABSTRACT: present' end, x), ' ' || chr(10)) plan from (select distinct doc_id from documents) left join facts using (doc_id) left join plan using (doc_id)
"""
_MADE = "select doc_id, string_agg(raw, chr(10) order by pos) text from m1 group by doc_id"
ORACLES["section_chunks"] = f"""
with recursive {_MARKDOWN}, body as (select doc_id, case when kind = 'abstract' then -1 else sec * 100000 + case when kind = 'sub' then sub else 0 end end part, pos,
  regexp_replace(translate(translate(line, '{tx.UNUSUAL}', '{tx.USUAL}'), '{tx.SMALL}', '{tx.PLAIN}'), '[ \t]+', ' ', 'g') line, case when kind = 'abstract' then 'Abstract' else section end section, case when kind = 'sub' then subsection else '' end subsection
  from headed where lv = 0 and kind in ('abstract', 'section', 'sub')),
{_packed_lines("select doc_id id, part, pos i, line from body where part >= 0", 60, 20)},
names as (select distinct doc_id, part, section, subsection from body),
every as (select doc_id, part, 0 h, string_agg(line, chr(10) order by pos) chunk from body where part = -1 group by doc_id, part union all select id, part, h, chunk from packed),
whole as (select doc_id, 0 chunk, 'Full document' section, '' subsection, text from ({_MADE}) where doc_id not in (select doc_id from every))
select doc_id, (row_number() over (partition by doc_id order by part, h) - 1)::int chunk, section, subsection, chunk "text" from every join names using (doc_id, part) union all select * from whole
"""
ORACLES["line_segments"] = r"""
with p as (select conv_id, turn, regexp_extract_all(text, '[\n\v]|[^\n\v]+') s from conversations), u as (select conv_id, turn, (unnest(range(len(s))))::int pos, unnest(s) segment from p)
select *, len(list_filter(string_split(regexp_replace(segment, '([.!?])[ \t\n\v\f\r]+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) <> ''))::int n from u
"""
_PAIRS = ", ".join(f"{{'t': {Duck.lit(t)}, 'w': {Duck.lit(w)}, 'b': {Duck.lit(w.rstrip())}}}" for t, *ws in (x.split(",") for x in dic.TAG_LINES) for w in ws)
ORACLES["legacy_tags"] = f"""
with l as (select doc_id, pos, {tx.ascii_fold(Duck, 'line')} phrase from (select doc_id, (unnest(range(len(s))))::int pos, unnest(s) line from (select doc_id, string_split(text, chr(10)) s from documents))),
k as (select *, list_reduce(list_concat([{{'t': '', 'w': '', 'b': ''}}], [{_PAIRS}]), lambda a, x: case when contains(phrase, x.b) and not contains(a.t, x.t) then {{'t': a.t || x.t || ';', 'w': a.w || x.w || ';', 'b': ''}} else a end) f from l)
select doc_id, pos, phrase, left(f.t, greatest(0, length(f.t) - 1)) tags, left(f.w, greatest(0, length(f.w) - 1)) motcle from k
"""
ORACLES["word_order"] = rf"""
with t as (select doc_id, regexp_extract_all(lower(text), '\p{{L}}+') ws from documents), u as (select doc_id, unnest(range(len(ws))) pos, unnest(ws) w from t), k as (select strip_accents(w) mot, doc_id, pos from u where w not in ({words(dic.NGRAM_STOPWORDS)}))
select mot, count(*) occurrences, min(doc_id) first_doc, arg_min(pos, (doc_id, pos))::int first_pos from k group by mot
"""
_VISITS = f"""
v as (select page_id, case when page_id % 5 = 0 then url || '/2024/x' when page_id % 7 = 0 then url || '/2023/x' else url end url, case when page_id % 3 = 0 then '<time datetime="x"></time>' || html else html end html, page_id % 12 = 0 bad from pages),
y as (select *, {web.page_year(Duck, 'html', 'url')} as year, {web.news_score(Duck, 'html')} score, {Duck.match('html', web.ANTIBOT)} blocked from v),
visits as (select *, case when bad or blocked then 'error' when score < 3 then 'not_article' when coalesce(year, 2024) <> 2024 then 'skipped_year' else 'saved' end status from y)
"""
ORACLES["crawl_visits"] = f"with {_VISITS} select page_id, url, status, year, case when status = 'saved' then {tx.url_filename(Duck, 'url')} end file, case when status = 'error' then case when bad then '404' else 'anti-bot page' end end detail from visits"
ORACLES["crawl_stats"] = f"with {_VISITS} select status, count(*) n, count(distinct url) n_urls from visits group by status"
ORACLES["crawl_quota"] = f"""
with p as (select page_id, url, split_part({tx.domain(Duck, 'url')}, '.', -1) site from pages), j as (select url, max((page_id % 8 = 0)::int) saved from p where page_id % 4 = 0 group by url),
k as (select p.*, j.url is null fresh, coalesce(sum(case when j.url is null then 1 else saved end) over (partition by site order by page_id rows between unbounded preceding and 1 preceding), 0) had from p left join j using (url))
select page_id, url, site from k where fresh and had < 20
"""
_YEARS = r"list_filter(list_transform(regexp_extract_all(text, '\b((?:19|20)\d{2})\b', 1), lambda y: y::int), lambda y: y <= year(current_date))"
_RENAMES = f"""
f as (select doc_id::varchar path, 'file-' || lpad(doc_id::varchar, 9, '0') || '.pdf' old, split_part(text, chr(10), 1) title, coalesce(list_max({_YEARS})::varchar, 'UNKNOWN') y from documents),
n as (select path, old, title, {tx.final_name(Duck, 'y', 'title')} new from f), r as (select *, row_number() over (partition by new order by old) k from n),
plan as (select path, old, case when k > 1 then regexp_replace(new, '\\.[^.]*$', '') || '_' || k || regexp_extract(new, '\\.[^.]*$') else new end new, case when length(trim(title)) < 5 or upper(trim(title)) = 'TITRE INCONNU' or starts_with(upper(trim(title)), 'ERREUR') then 'failed' when new = old then 'unchanged' else 'renamed' end "action" from r)
"""
ORACLES["rename_plan"] = f'with {_RENAMES} select path, old, new, "action" from plan'
ORACLES["rename_counts"] = f'with {_RENAMES} select "action", count(*) n from plan group by 1'


def _cut(x: str) -> str:
    """Trimmed parts at white space behind . ! ? and at line ends, empty ones out."""
    return rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({x}, '([!.?])[\s\v]+', '\1' || chr(31), 'g'), '\n+', chr(31), 'g'), chr(31)), lambda y: trim(y, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))), lambda y: y <> '')"


def _answer(src: str, keep: str, body: str = "body") -> str:
    """The offline generator's answer ``a`` to each row's ``body``: three sentences with figures, else two."""
    return f"""select {keep}, array_to_string(list_transform(case when len(d) > 0 then d[1:3] else p[1:2] end, lambda y: '- ' || y), chr(10)) a
  from (select *, list_filter(p, lambda y: regexp_matches(y, '[0-9]')) d from (select *, {_cut(body)} p from ({src})))"""


ORACLES["doc_summaries"] = f"""
with chunks as ({_chars(7000)}), notes as ({_answer('select doc_id, pos, chunk body from chunks', 'doc_id, pos')}),
grouped as (select doc_id, pos // 6 g, string_agg(a, chr(10) order by pos) body from notes group by all), merged as ({_answer('from grouped', 'doc_id, g')}),
whole as (select doc_id, string_agg(a, chr(10) order by g) body from merged group by all), done as ({_answer('from whole', 'doc_id')})
select doc_id, case when trim(a) = '' then 'ERREUR : résumé vide' else a end summary from done
"""
_GREEDY_1000 = _greedy(f"select *, {_COUNT} n from ({_LINES_OF})", 1000, r"array_to_string(regexp_extract_all(line, '[^ \t\n\r\f\v]+')[k * 1000 + 1 : k * 1000 + 1000], ' ')", "(n + 999) // 1000")
_BULLETS = r"list_filter(list_transform(list_filter(list_transform(string_split(a, chr(10)), lambda y: trim(y)), lambda y: y <> '' and upper(y) <> 'NONE'), lambda y: trim(regexp_replace(regexp_replace(regexp_replace(y, '^- ', ''), '^\s*[-•*\d.)(]+\s*', ''), '[\s\v]+', ' ', 'g'), ' -•*')), lambda y: y <> '')"
ORACLES["doc_ideas"] = rf"""
with chunks as ({_GREEDY_1000}), back as (select doc_id, pos, array_to_string(list_reverse(string_split(regexp_replace(chunk, '([.!?])[\s\v]+', '\1' || chr(31), 'g'), chr(31))), chr(10)) body from chunks),
asked as ({_answer('select doc_id, pos, 1 pass, chunk body from chunks union all select doc_id, pos, 2, body from back', 'doc_id, pos, pass')}),
lines as (select doc_id, pos chunk, pass, unnest(range(len(b)))::int pos, unnest(b) raw from (select *, {_BULLETS} b from asked)),
ideas as (select doc_id, pass, chunk, pos, {tx.idea(Duck, 'raw')} idea from lines), keyed as (select *, {tx.idea_key(Duck, 'idea')} k from ideas)
select doc_id, pass, chunk, pos, idea from keyed where k <> '' qualify row_number() over (partition by doc_id, k order by pass, chunk, pos) = 1
"""


def _spaced(x: str) -> str:
    """P6 and P7; what follows and what precedes a power of ten is matched and put back."""
    x = rf"regexp_replace(regexp_replace(regexp_replace(translate({x}, '{tx.UNUSUAL}', '{tx.USUAL}'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n\n\n+', chr(10) || chr(10), 'g')"
    x = rf"regexp_replace(translate({x}, '{tx.SMALL}', '{tx.PLAIN}'), '([x×])[\s\v]*10 *([+-]) *(\d+)($|[^/\d])', '\1 10^\2\3\4', 'g')"
    return rf"trim(regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}])10 *([+-]) *(\d+)($|[^/\d])', '\110^\2\3\4', 'g'), ' ' || chr(9) || chr(10) || chr(13))"


def _numeric(x: str) -> str:
    """P13."""
    x = rf"regexp_replace(regexp_replace(regexp_replace({_spaced(x)}, '\([\s\v]+', '(', 'g'), '[\s\v]+\)', ')', 'g'), '[\s\v]+', ' ', 'g')"
    return rf"trim(regexp_replace(trim({x}, ' -•;,' || chr(9)), '(?i)^\s*(refs?\.?|\d+\.|\[\d[\d, ]*\])\s+', ''))"


_HOLD = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)\bet al\.', 'et al', 'g'), '(?i)\be\.g\.', 'eg', 'g'), '(?i)\bi\.e\.', 'ie', 'g'), '(?i)\b(" + tx.ABBREVIATIONS.replace(" ", "|") + r")\.', '\1<DOT>', 'g')"
_GOES_ON = r"(regexp_matches({x}, '^(\p{{Ll}}|[)\],;:%])') or regexp_matches({x}, '(?i)^(but|and|or|including|respectively|while|whereas|with) '))"
_OPEN = r"(length({x}) < 30 or regexp_matches({x}, '[(,:;\[]\s*$') or regexp_matches({x}, '(?i)^(but|and|or|including|such as|while|whereas|with) ') or regexp_matches({x}, '(?i)\b(including|that|where|whereas|which|while|compared with|respectively)\s*$'))"
_has = lambda x: p.number(Duck, x)  # noqa: E731
_JOINS = f"{_has('a[-1]')} and {_OPEN.format(x='a[-1]')} or {_has('x[1]')} and {_GOES_ON.format(x='x[1]')} or {_has('a[-1]')} and {_has('x[1]')} and length(a[-1]) < 45"
_no = lambda x, *fs: " and ".join([p.number(Duck, x), *(f"not {f(Duck, x)}" for f in fs)])  # noqa: E731
_SPLIT = r"list_transform(string_split_regex(h, '\n\n+'), lambda q: string_split(regexp_replace(replace(q, chr(10), ' '), '([.!?;])[\s\v]+([\p{Lu}\d(\[])', '\1' || chr(31) || '\2', 'g'), chr(31)))"
ORACLES["numeric_facts"] = f"""
with d as (select doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda q: trim(q, ' ' || chr(9) || chr(10) || chr(13))), lambda q: length(q) >= 1) ps from documents),
paras as (select * from (select doc_id, (unnest(range(len(ps))))::int para, unnest(ps) paragraph from d) where regexp_matches(paragraph, '[0-9]')),
held as (select *, {_spaced('paragraph')} n0 from paras), marked as (select *, {_HOLD.format(x='n0')} h from held),
cuts as (select *, list_filter(list_transform(flatten({_SPLIT}), lambda y: trim(replace(y, '<DOT>', '.'))), lambda y: y <> '') c from marked),
folded as (select *, case when len(c) = 0 then [] else list_reduce(list_transform(c, lambda y: [y]), lambda a, x: case when {_JOINS} then list_concat(a[1:len(a) - 1], [a[-1] || ' ' || x[1]]) else list_concat(a, x) end) end m from cuts),
rows_ as (select doc_id, para, (unnest(range(len(m))))::int pos, unnest(m) raw from folded), clean as (select *, {_numeric('raw')} sentence from rows_),
one as (select doc_id, para, pos, sentence from clean where sentence <> '' and {_no('sentence', p.layout_fragment, p.metadata, p.date_only, p.reference_fragment)}),
keys as (select doc_id, list({tx.numeric_key(Duck, 'sentence')}) ks from one where length(sentence) >= 25 group by doc_id),
rest as (select paras.* from paras left join keys using (doc_id) where ks is null or len(list_filter(ks, lambda k: contains({tx.numeric_key(Duck, 'paragraph')}, k))) = 0),
raws as (select doc_id, para, (unnest(range(len(string_split(paragraph, chr(10))))))::int pos, unnest(string_split(paragraph, chr(10))) raw from rest), two0 as (select *, {_numeric('raw')} sentence from raws),
two as (select doc_id, para, pos, sentence from two0 where {_no('sentence', p.layout_fragment, p.metadata, p.date_only, p.page_counter, p.caption, p.journal)}),
every as (select *, row_number() over (partition by doc_id order by pass, para, pos) place from (select *, 0 pass from one union all select *, 1 from two)),
scored as (select *, {p.score(Duck, 'sentence')} score, {tx.numeric_key(Duck, 'sentence')} k from every),
best as (select doc_id, k, min(place) place, arg_min(sentence, (-score, -length(sentence), place)) sentence, max(score) score from scored where score >= 1 group by doc_id, k)
select doc_id, row_number() over (partition by doc_id order by place) pos, sentence, score from best qualify row_number() over (partition by doc_id order by place) <= 400
"""
ORACLES["sentiment_pct"] = rf"""
with x(w, v) as (values {', '.join(f"('{w}', {v}::double)" for w, v in dic.SENTIMENT.items())}), s as ({SENTENCES}),
t as (select doc_id, pos, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+')) w from s), v as (select doc_id, pos, sum(v) t from t join x using (w) group by all),
c as (select s.doc_id, coalesce(t, 0) / sqrt(coalesce(t, 0) * coalesce(t, 0) + 15) c from s left join v using (doc_id, pos)),
p as (select doc_id, round(100.0 * count(*) filter (c > 0.05) / count(*), 2) positif, round(100.0 * count(*) filter (c < -0.05) / count(*), 2) negatif, round(100.0 * count(*) filter (c between -0.05 and 0.05) / count(*), 2) neutre from c group by doc_id)
select doc_id, coalesce(positif, 0) positif, coalesce(negatif, 0) negatif, coalesce(neutre, 0) neutre from (select distinct doc_id from documents) left join p using (doc_id)
"""
ORACLES["language_guess"] = rf"""
with x(lang_, w) as (values {', '.join(f"('{k}', '{w}')" for k, ws in dic.LANGUAGE_WORDS.items() for w in ws)}), t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) w from documents),
k as (select doc_id, lang_, count(*) n from t join x using (w) group by all), g as (select doc_id, arg_min(lang_, (-n, lang_)) detected from k group by doc_id)
select lang, detected, count(*) n from documents left join g using (doc_id) group by all
"""
ORACLES["tfidf_terms"] = rf"""
with r as (select conv_id || ':' || turn id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w not in ({words(dic.TOPIC_STOPWORDS)})) t from conversations),
u as (select id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) term from r), tf as (select id, term, count(*) tf from u group by all), d as (select term, count(*) df from tf group by term), n as (select count(*) n from r),
w as (select id, term, tf * (ln((1 + n) / (1 + df)) + 1) w from tf join d using (term), n where df >= 2 and df <= 0.9 * n), l as (select id, sqrt(sum(w * w)) l from w group by id)
select term, round(sum(w / l), 4) weight, count(*) n from w join l using (id) group by term
"""
ORACLES["title_names"] = f"""
with t as (select doc_id, split_part(text, chr(10), 1) || '.pdf' line from documents), n as (select doc_id, {tx.title_part(Duck, 'line')} title, {tx.final_name(Duck, "'2024'", 'line')} name from t), r as (select *, row_number() over (partition by name order by doc_id) k from n)
select doc_id, title, case when k > 1 then regexp_replace(name, '\\.[^.]*$', '') || '_' || k || regexp_extract(name, '\\.[^.]*$') else name end name from r
"""
ORACLES["merged_ranges"] = """
with r as (select l_suppkey, l_partkey * 10 s, l_partkey * 10 + l_quantity::bigint e from lineitem), m as (select *, max(e) over (partition by l_suppkey order by s, e rows between unbounded preceding and 1 preceding) reach from r where s < e),
i as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by l_suppkey order by s, e rows unbounded preceding) k from m)
select l_suppkey, min(s) "start", max(e) "end" from i group by l_suppkey, k
"""
