"""The queries of plans/queries.py in DuckDB's SQL, written apart from them, for those that SQL can express."""

from __future__ import annotations

from lexspark.functions import rules_hr as hr

DOCS = """docs as (select doc_id as id, '/eli/sluzbeni/' || (1990 + doc_id % 30) || '/' || (1 + doc_id % 120) || '/' || doc_id as eli, lang as vrsta,
 'NN ' || (1 + doc_id % 120) || '/' || (1990 + doc_id % 30) as izdanje, source as donositelj,
 (1 + doc_id % 28) || '.' || (1 + doc_id % 12) || '.' || (1990 + doc_id % 30) || '.' as datum, string_split(text, chr(10))[1] as naslov, text as doc_cleaned from documents)"""
LINES = """lines as (select doc_id, unnest(range(len(ls)))::int as p, unnest(ls) as x from (select doc_id, string_split(text, chr(10)) as ls from documents))"""
MARKED = f"""{LINES}, marked as (select doc_id, p, trim(regexp_replace(case when p % 21 = 20 then 'IV. NASLOV ' || p when p % 7 = 3 then 'Član ' || p || '.'
 when p % 3 = 1 then '(' || p || ') ' || trim(x) else x end, '\\s+', ' ', 'g')) as text from lines)"""
CARRIED = rf"""{MARKED}, kinds as (select doc_id, p as pos, text, case when regexp_matches(text, '{hr.CHAPTER}') then 'chapter' when regexp_matches(text, '{hr.ARTICLE}') then 'article' else 'paragraph' end as kind from marked where text <> ''),
runs as (select *, last_value(case when kind = 'chapter' then text end ignore nulls) over w as chapter, last_value(case when kind = 'article' then text end ignore nulls) over w as article,
 sum(case when kind = 'chapter' then 1 else 0 end) over w as chapter_run, sum(case when kind <> 'paragraph' then 1 else 0 end) over w as article_run
 from kinds window w as (partition by doc_id order by pos rows between unbounded preceding and current row)),
carried as (select *, last_value(nullif(l, '') ignore nulls) over v as label, sum(case when l <> '' then 1 else 0 end) over v as label_run from (select *, regexp_extract(text, '{hr.PARAGRAPH}') as l from runs where kind = 'paragraph')
 window v as (partition by doc_id, article_run order by pos rows between unbounded preceding and current row))"""
NEWEST = "order by datum desc nulls first, id desc"
FOUND = "(naslov ilike '%the%' or doc_cleaned ilike '%the%')"
SENTENCES = r"""sentences as (select doc_id, unnest(range(len(ss)))::int as pos, unnest(ss) as s from (select doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as ss from documents))"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _page(n: int) -> str:
    return f"with {DOCS} select id, eli, null::double as score, 'lexical' as match_type from docs where {FOUND} {NEWEST} limit 10 offset {10 * (n - 1)}"


# Character references that occur in the test pages, and what they stand for.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _html(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->|<![^>]*>', ' ', 'g')"
    for tag in ("script", "style", "template"):
        x = f"regexp_replace({x}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)</?[A-Za-z][^>]*>', ' ', 'g')"
    for a, b in ENTITIES:
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _deduped(rows: str, longest: int) -> str:
    """rows: a query of doc_id, ord (an order), x."""
    return f"""select doc_id, (row_number() over (partition by doc_id order by ord) - 1)::int as pos, left(x, {longest}) as item from
 (select *, row_number() over (partition by doc_id, lower(left(x, 60)) order by ord) as r from (select doc_id, ord, trim(x) as x from ({rows}) where trim(x) <> '')) where r = 1"""


def _phrased(*phrases: str) -> str:
    cases = " ".join(f"when p % 5 = {k} then trim(x) || ' {p}'" for k, p in enumerate(phrases))
    return f"{LINES}, phrased as (select doc_id, p, case {cases} else x end as x from lines)"


def _holding(phrases: str) -> str:
    return f"regexp_matches(x, {_quoted(hr.marked(phrases))})"


def _extracted(kind: str, phrases: str, *added: str) -> str:
    return f"with {_phrased(*added)} {_deduped(f'select doc_id, p as ord, x from phrased where {_holding(phrases)}', hr.LENGTHS[kind])}"


def _deadlines(text: str, keep: str = "doc_id") -> str:
    each = " union all ".join(f"select doc_id, {k} as k, unnest(range(len(m))) as j, unnest(m) as x from (select doc_id, regexp_extract_all({text}, {_quoted('(?i)' + p)}) as m from texts)" for k, p in enumerate(hr.DEADLINES))
    return _deduped(f"select doc_id, k * 1000000 + j as ord, x from ({each})", hr.LENGTHS["deadlines"])


def _panel() -> str:
    added = ("dužan je", "primjenjuje se na sve", "novčana kazna u roku od 8 dana")
    parts = [f"select '{name}' as section, doc_id, pos, item from ({_deduped(f'select doc_id, p as ord, x from phrased where {_holding(phrases)}', 250)})" for name, phrases in (("obligations", hr.OBLIGATION), ("scope", hr.SCOPE), ("sanctions", hr.SANCTION))]
    parts += [f"select 'deadlines', doc_id, pos, item from ({_deadlines('x')})"]
    return f"""with {_phrased(*added)}, texts as (select doc_id, string_agg(x, chr(10) order by p) as x from phrased group by doc_id),
 found as (select section, doc_id, count(*) as n, sha256(string_agg(item, chr(10) order by pos) filter (pos < 5)) as digest from ({' union all '.join(parts)}) group by all),
 keyed as (select doc_id, bool_or(section in ('obligations', 'deadlines')) as has_key_info from found group by doc_id)
 select doc_id, has_key_info, section, least(n, 5)::bigint as shown, digest, greatest(n - 5, 0)::bigint as more from found join keyed using (doc_id)"""


def _titled(t: str) -> str:
    """The text with a capital at the start of each run of letters; ß has two."""
    cs = f"string_split({t}, '')"
    return f"(select array_to_string(list_transform(range(1, len(q.cs) + 1), lambda i: case when i > 1 and regexp_matches(q.cs[i - 1], '^\\p{{L}}') then lower(q.cs[i]) when q.cs[i] = 'ß' then 'Ss' else upper(q.cs[i]) end), '') from (select {cs} as cs) q)"


def _list_items() -> str:
    blank = r"'^\s+|\s+$'"
    return rf"""with recursive {LINES}, marked as (select doc_id, p, case p % 4 when 1 then '1. ' || x when 2 then '2. ' || x when 3 then '- ' || x else x end as line from lines),
 own as (select *, regexp_replace(line, {blank}, '', 'g') as o from marked),
 flagged as materialized (select doc_id, p, line, o, regexp_matches(o, '^[0-9]+\.\s*.') as numbered, regexp_matches(o, '^-\s*.') as dashed, case when regexp_matches(o, '^[0-9]+\.\s*.') then regexp_extract(o, '^([0-9]+)\.', 1)::double end as number,
  regexp_replace(o, '^([0-9]+\.|-)\s*', '') as body, regexp_matches(o, '^([a-zäöü]|$)') as small from own),
 fold as (select doc_id, p, 0 as block, case when numbered then 'decimal' when dashed then 'disc' else 'paragraph' end as kind, coalesce(number, 0) as last, case when numbered or dashed then body else line end as item from flagged where p = 0
  union all select doc_id, p, case when same then block else block + 1 end, case when same then kind when numbered then 'decimal' when dashed then 'disc' else 'paragraph' end, coalesce(number, 0), case when numbered or dashed and not same then body when same then o else line end
  from (select f.doc_id, g.p, f.block, f.kind, g.line, g.o, g.numbered, g.dashed, g.number, g.body, g.numbered and f.kind = 'decimal' and (g.number = f.last + 1 or f.last = 0) or not g.numbered and not g.dashed and f.kind <> 'paragraph' and g.small as same
   from fold f join flagged g on g.doc_id = f.doc_id and g.p = f.p + 1))
 select doc_id, block as pos, any_value(kind) as kind, count(*)::int as n, sha256(string_agg(item, chr(10) order by p)) as digest from fold group by doc_id, block"""


def _legal_sentences() -> str:
    words = "|".join(hr.ABBREVIATIONS)
    return rf"""with cut as (select doc_id, string_split(regexp_replace(trim(text), '([.!?])(\s+)([A-ZŠĐČĆŽ])', '\1' || chr(1) || '\2\3', 'g'), chr(1)) as ps from documents),
 pieces as (select doc_id, unnest(range(len(ps))) as i, unnest(ps) as x from cut),
 told as (select *, regexp_matches(x, '[0-9][.!?]$') or regexp_matches(x, {_quoted(f'(?i)(?:^|[ ])(?:{words})[.!?]$')}) or regexp_matches(x, '(?:^|[ ])\S?[.!?]$') as goes_on from pieces),
 runs as (select *, coalesce(sum((not goes_on)::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as run from told),
 whole as (select doc_id, run, string_agg(x, '' order by i) as x from runs group by doc_id, run)
 select doc_id, (row_number() over (partition by doc_id order by run) - 1)::int as pos, s as sentence from (select doc_id, run, trim(case when run > 0 then regexp_replace(x, '^\s+', '') else x end) as s from whole) where s <> ''"""


# Fields of the fuzzy search and their weights.
FUZZY = {"naslov": 0.5, "eli": 0.2, "izdanje": 0.15, "short_summary": 0.1, "donositelj": 0.05}


def _scored(query: str, rows: str = "own") -> str:
    """rows with score (null without a match) and marks, for a query of ASCII letters: each field's least distance between the query and any piece of it. What is not ASCII is
    one byte first, for distances here are of bytes."""
    q, n = query.lower(), len(query)
    far = int(0.7 * n)
    letters = "[" + "".join(sorted(set(q + q.upper()))) + "]{2,}"
    plains, leasts, factors, marks = [], [], [], []
    for i, (c, w) in enumerate(FUZZY.items()):
        plains.append(f"lower(regexp_replace(coalesce({c}, ''), '[^\\x00-\\x7F]', chr(1), 'g')) as p{i}")
        windows = f"list_transform(range(1, length(p{i}) + 1), lambda p: least({', '.join(f'levenshtein(substr(p{i}, p, {k}), {_quoted(q)})' for k in range(max(1, n - far), n + far + 1))}))"
        leasts.append(f"least({n}, coalesce(list_min({windows}), {n})) as l{i}")
        same = f"lower({c}) = {_quoted(q)}"
        fits = f"trim(coalesce({c}, '')) <> '' and (l{i} <= {far} and regexp_matches(p{i}, '{letters}') or {same})"
        factors.append(f"case when {fits} then pow(case when {same} then {2.0**-52!r} else greatest(l{i} / {n}, 0.001) end, {w} * floor(1000 / sqrt(len(regexp_extract_all({c}, '[^ ]+'))) + 0.5) / 1000) end as f{i}")
        marks.append(f"case when {fits} then case when {same} then [{c}] else regexp_extract_all({c}, '{letters}')[1:3] end else [] end")
    names = [f"f{i}" for i in range(len(FUZZY))]
    return f"""select *, case when coalesce({', '.join(names)}) is not null then round(1 - {' * '.join(f'coalesce({x}, 1)' for x in names)}, 6) end as score, array_to_string(m[1:3], '|') as marks
 from (select *, {', '.join(factors)}, list_concat({', '.join(marks)}) as m from (select *, {', '.join(leasts)} from (select *, {', '.join(plains)} from {rows})))"""


_COS = "list_cosine_similarity({}::double[], {}::double[])"


def _mmr() -> str:
    sim = lambda a, b: f"round({_COS.format(a, b)}, 6)"
    return f"""with dims as (select label, d, avg(x::double) as m from (select label, unnest(range(len(embedding))) as d, unnest(embedding) as x from embeddings) group by all),
 means as (select label, list(m order by d) as c from dims group by label),
 r0 as (select e.label, vec_id, embedding, {sim('embedding', 'c')} as r from embeddings e join means using (label)),
 p0 as (select label, vec_id, embedding from (select *, row_number() over (partition by label order by r desc, vec_id) as n from r0) where n = 1),
 r1 as (select r0.*, {sim('r0.embedding', 'p0.embedding')} as m from r0 join p0 using (label) where r0.vec_id <> p0.vec_id),
 p1 as (select label, vec_id, embedding from (select *, row_number() over (partition by label order by round(0.7 * r - (1 - 0.7) * m, 6) desc, vec_id) as n from r1) where n = 1),
 r2 as (select r1.label, r1.vec_id, r1.r, greatest(m, {sim('r1.embedding', 'p1.embedding')}) as m from r1 join p1 using (label) where r1.vec_id <> p1.vec_id),
 p2 as (select label, vec_id from (select *, row_number() over (partition by label order by round(0.7 * r - (1 - 0.7) * m, 6) desc, vec_id) as n from r2) where n = 1)
 select label, vec_id, 0 as pick from p0 union all select label, vec_id, 1 from p1 union all select label, vec_id, 2 from p2"""


OWN = "own as (select *, donositelj || ': ' || naslov as short_summary from docs)"


def _fallback(query: str, scored: str) -> str:
    q = _quoted(query)
    return f"""select eli, (row_number() over (order by bucket, s desc, datum desc, eli))::int as rank, s as score, bucket, case when bucket = 1 then marks else '' end as highlights from
 (select eli, datum, marks, (score is not null)::int as bucket, coalesce(score, 0.99) as s from {scored} where score is not null or contains(lower(naslov), {q}) or contains(lower(short_summary), {q}) order by bucket, s desc, datum desc, eli limit 20)"""


INDEX = f"""{DOCS}, idx as (select eli, izdanje, naslov, vrsta, datum, donositelj, null::varchar as "brojDokumenta", donositelj || ': ' || naslov as short_summary from docs)"""


def _manifest() -> str:
    fields = ", ".join(f"coalesce({c}, chr(0))" for c in ("eli", "izdanje", "naslov", "vrsta", "datum", "donositelj", '"brojDokumenta"', "short_summary"))
    parts = ", ".join(f"sum(('0x' || substr(d, {1 + 12 * j}, 12))::bigint::hugeint) as s{j}" for j in range(4))
    return f"""with {INDEX}, digests as (select sha256(concat_ws(chr(31), {fields})) as d from idx), sums as (select count(*) as count, {parts} from digests),
 named as (select left(sha256(concat_ws('-', count::varchar, s0::varchar, s1::varchar, s2::varchar, s3::varchar)), 16) as hash, count from sums)
 select 'search-index.' || hash || '.json' as file, hash, count from named"""


def oracle_sql() -> dict[str, str]:
    docs = f"with {DOCS} "
    carried = f"with {CARRIED} "
    titled = rf"""list_filter(list_transform(list_transform(string_split(regexp_replace(trim(regexp_replace(t, '\(.*?\)', '', 'g')), '(?i)\s+i\s+|\s*,\s*|\s+te\s+', chr(1), 'g'), chr(1)),
 lambda p: trim(regexp_replace(trim(p), '(?i)^(?:{hr.ACTS})\s+o\s+', ''))), lambda p: array_to_string(list_filter(string_split_regex(p, '\s+'), lambda w: not list_contains([{", ".join(map(_quoted, hr.STOP_WORDS))}], lower(w)) and len(w) > 2), ' ')), lambda p: p <> '')"""
    return {
        "lexical_search": _page(1),
        "lexical_search_page2": _page(2),
        "list_filtered": docs + f"select id, eli, vrsta, izdanje, donositelj, datum, naslov from docs where vrsta ilike '%en%' and izdanje ilike '%/20%' {NEWEST} limit 20",
        "search_total_pages": docs + f"select count(*) as total, greatest(1, ceil(count(*) / 10))::bigint as pages from docs where {FOUND}",
        "suggest_titles": docs + f"select id, eli, naslov from docs where naslov ilike '%an%' {NEWEST} limit 8",
        "doc_detail_nested": docs + "select id, eli, 'short=' || naslov || '|title=' || eli as summaries, len(string_split(doc_cleaned, chr(10)))::bigint as n_segments, sha256(doc_cleaned) as digest, quality, toxic from docs left join labels on doc_id = id",
        "summaries_pivot": docs + "select id as document_id, naslov as short, doc_cleaned as detailed from docs",
        "short_summary_join": docs + "select id, eli, 'q' || quality as short_summary from docs left join labels on doc_id = id",
        "clean_html": f"select page_id, {_html('html')} as text from pages",
        "page_links": f"""select page_id, {_html("regexp_extract(html, pat, 2)")} as text, nullif(regexp_extract(html, pat, 1), '') as href from (select *, '(?is)<a\\s[^>]*?href\\s*=\\s*["''](' || '[^"'']*' || ')["''][^>]*>(.*?)</a>' as pat from pages)""".replace("regexp_extract(html, pat,", r"""regexp_extract(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>',"""),
        "page_rows": """with p as (select page_id, page_id::varchar as s, replace(url, '&', '&amp;') as u, case when page_id % 13 = 5 then 'no details' when page_id % 5 = 0 then 'link without address' when page_id % 17 = 3 then 'no title' when page_id % 5 = 1 then 'no identifier' end as refused from pages),
 f as (select *, case when page_id % 2 = 0 then 'Zakon' when page_id % 3 = 0 then 'Stranica tiskanog izdanja: 7' end as v, page_id % 2 <> 0 and page_id % 3 = 0 as nested from p)
 select page_id, refused, case when refused is null then 'Služ' || 'beni' end as dio, case when refused is null then v end as vrsta,
 case when refused is null then case when page_id % 3 = 1 then 'NN ' || s || '/1990' else 'NN ' || s || '/1990' end end as izdanje, case when refused is null and page_id % 3 <> 1 then '/izdanje?a=1&b=' || s end as "izdanjeUrl", null::varchar as "brojDokumenta",
 case when refused is null and nested then 'Vrsta dokumenta: 7' end as stranica, case when refused is null then 'Sabor <RH>' end as donositelj, case when refused is null then '13.2.1990.' end as datum,
 case when refused is null then case when page_id % 5 = 2 then '' else '/eli/sluzbeni/1990/1/' || s end end as eli, case when refused is null then case when page_id % 5 = 2 then 'https://example.org/eli/sluzbeni/1990/' || s || '/9' else '/eli/sluzbeni/1990/1/' || s end end as "eliUrl",
 case when refused is null then 'Naslovš' || s end as naslov, case when refused is null and page_id % 7 <> 2 then '<div class="article-column a"><p>' || u || '<br/>"</p><!-- c --></div>' end as doc,
 case when refused is null then '1990' else refused end as year, case when refused is null then case when page_id % 5 = 2 then '9' else s end end as document from f""",
        "page_headings": r"""select page_id, trim(h) as heading, regexp_extract(html, '<nav><ul><li><a[^>]*>([^<]*)</a>', 1) as first_item, '<h1>' || replace(replace(replace(h, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</h1>' as markup
 from (select page_id, html, replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as h from pages)""",
        "sitemap_locations": "select page_id, url as loc from pages where url like 'http%' and url like '%.html'",
        "sitemap_pages": "select url as loc, min('http://h/sitemap_m' || (page_id // 100) || '.xml') as via from pages where url like 'http%' and url like '%.html' group by url",
        "sentence_split": f"with {SENTENCES} select doc_id, pos, s as sentence from sentences",
        "parse_dates": docs + r"select id, datum, try_strptime(regexp_extract(datum, '\d{1,2}\.\d{1,2}\.\d{4}'), '%d.%m.%Y')::date as publication_date from docs",
        "normalize_issue": docs + r"""select id, case when regexp_matches(t, '^\d{1,3}/\d{4}$') then 'NN ' || t when regexp_matches(t, '(?i)^nn\s+\d{1,3}/\d{4}$') then 'NN ' || regexp_extract(t, '\d{1,3}/\d{4}$') else t end as izdanje
 from (select id, trim(case when id % 3 = 0 then replace(izdanje, 'NN ', '') when id % 3 = 1 then replace(izdanje, 'NN ', ' nn  ') else 'x ' || izdanje end) as t from docs)""",
        "eli_paths": docs + "select id, replace(eli, '/eli/sluzbeni/', '') as path, '/documents' || eli as page, '/data' || eli || '.json' as url, string_split(eli, '/')[4] as year, string_split(eli, '/')[5] as issue, string_split(eli, '/')[6] as document from docs",
        "title_subjects": docs + f"select id, array_to_string({titled}, '|') as subjects from (select id, 'Zakon o ' || naslov || ' (prečišćeni tekst) i dopunama' as t from docs)",
        "title_case": docs + f"select id, {_titled('naslov')} as title from docs",
        "list_items": _list_items(),
        "legal_sentence_split": _legal_sentences(),
        "extract_subjects": f"""with {_phrased('')}, firsts as (select doc_id, x as h, 'Zakon o ' || x as t from phrased where p = 0), titled as (select doc_id, {titled} as s from firsts)
 {_deduped(f"""select doc_id, j as ord, x from (select doc_id, unnest(range(len(s))) as j, unnest(s) as x from titled) union all select doc_id, 1000000, trim(regexp_replace('IV. ' || h, '^[IVX]+[.]?[ \\t\\r\\n\\f]+', '')) from firsts
 union all select doc_id, 2000000 + p, {_titled("trim(regexp_replace(x, '^[IVXLC]+[.]' || chr(92) || 's+', ''))")} from phrased where regexp_matches(x, {_quoted(hr.CAPITAL_HEADING)})""", hr.LENGTHS['subjects'])}""",
        "extract_bodies": rf"""with {_phrased('Ministarstvo Pravosuđa.', 'Visoki Sud za prekršaje.')}, each as (select doc_id, p, regexp_extract_all(x, {_quoted(rf'(?:^|[^\p{{L}}\p{{N}}_])({hr.BODY})')}, 1) as m from phrased where {_holding(hr.INSTITUTIONS)}),
 named as (select doc_id, p, unnest(range(len(m))) as j, trim(unnest(m)) as b from each)
 {_deduped(f"select doc_id, p * 1000000 + j as ord, b as x from named where regexp_matches(b, {_quoted(hr.marked(hr.INSTITUTIONS))}) or len(list_filter(string_split_regex(b, '[ ' || chr(9) || chr(10) || chr(13) || ']+'), lambda w: len(w) > 2 and not regexp_matches(w, '^' || chr(92) || 'p{{Lu}}'))) = 0", hr.LENGTHS['responsible_bodies'])}""",
        "article_fallback": rf"""with {LINES}, marked as (select doc_id, p, trim(case when p % 21 = 20 then 'IV. NASLOV ' || p when p % 7 = 3 then 'Član ' || p || '.' when p % 3 = 1 then '(' || p || ') ' || trim(x) else x end) as x from lines),
 pieces as (select doc_id, list_filter(list_transform(string_split(regexp_replace(string_agg(x, ' ' order by p), '(Član\s+\d+\.)', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as ps from marked group by doc_id)
 select doc_id, pos, regexp_extract(x, '^Član\s+\d+\.[^. ]*') as heading, trim(regexp_replace(x, '^Član\s+\d+\.[^. ]*', '')) as body from (select doc_id, unnest(range(len(ps)))::int as pos, unnest(ps) as x from pieces)""",
        "text_hash_join": "select v.doc_id as vec_id, v.source as document_id, s.segment_id from documents v join (select source, left(sha256(text), 12) as h, max(doc_id) as segment_id from documents group by all) s on s.source = v.source and s.h = left(sha256(v.text), 12)",
        "segment_paragraphs": carried + "select doc_id, pos, chapter, article, chapter_run::bigint as chapter_run, article_run::bigint as article_run, text from carried",
        "segment_articles": carried + """, arts as (select doc_id, article_run, any_value(chapter) as chapter, any_value(article) as article, trim(string_agg(text, ' ' order by pos)) as text from carried where article is not null group by doc_id, article_run)
 select doc_id, (row_number() over (partition by doc_id order by article_run) - 1)::int as segment_order, chapter, article, text from arts where text <> ''""",
        "segment_preamble": carried + "select doc_id, string_agg(text, ' ' order by pos) as opis from carried where article is null group by doc_id",
        "stavak_groups": carried + "select doc_id, article_run::bigint as article_run, label_run::bigint as label_run, max(label) as label, count(*) as n from carried where article is not null group by doc_id, article_run, label_run",
        "segment_nested": carried + """, g as (select doc_id, chapter_run, article_run, label_run, any_value(chapter) as ch, any_value(article) as art, '$' || coalesce(max(label), '') || '|' || string_agg(text, '|' order by pos) as x, count(*) as n from carried where article is not null group by all),
 a as (select doc_id, chapter_run, article_run, any_value(ch) as ch, '@' || any_value(art) || string_agg(x, '' order by label_run) as x, sum(n) as n from g group by doc_id, chapter_run, article_run),
 c as (select doc_id, chapter_run, '#' || coalesce(any_value(ch), '') || string_agg(x, '' order by article_run) as x, count(*) as articles, sum(n) as n from a group by doc_id, chapter_run)
 select doc_id, sha256(string_agg(x, '' order by chapter_run)) as digest, count(*)::bigint as n_chapters, sum(articles)::bigint as n_articles, sum(n)::bigint as n_items from c group by doc_id""",
        "extract_deadlines": f"with texts as (select doc_id, text || ' najkasnije u roku od ' || (doc_id % 60) || ' dana. Do 31. prosinca 1985. godine; u roku 15 dana.' as x from documents) {_deadlines('x')}",
        "extract_obligations": _extracted("obligations", hr.OBLIGATION, "dužan je", "MORAJU SE"),
        "extract_scope": _extracted("scope", hr.SCOPE, "primjenjuje se na sve", "ovim zakonom uređuje se"),
        "extract_sanctions": _extracted("sanctions", hr.SANCTION, "novčana kazna", "kaznit će se"),
        "keyinfo_panel": _panel(),
        "dedupe_ordered": f"with {LINES} {_deduped('select doc_id, p as ord, x from lines', 120)}",
        "overlap_chunks": f"""with {SENTENCES}, sized as (select doc_id, count(*) as n from sentences group by doc_id), starts as (select doc_id, n, unnest(range(0, n, 15)) as a from sized)
 select s.doc_id, (a / 15)::int as chunk, count(*)::int as n, sha256(string_agg(t.s, ' ' order by t.pos)) as digest from starts s join sentences t on t.doc_id = s.doc_id and t.pos >= a and t.pos < a + 20 group by s.doc_id, a""".replace("(a / 15)", "(a // 15)"),
        "token_pack": f"""with recursive {SENTENCES}, fold as (select doc_id, pos, s, 0 as chunk, len(s) as n from sentences where pos = 0
 union all select t.doc_id, t.pos, t.s, case when f.n + len(t.s) > 600 then f.chunk + 1 else f.chunk end, case when f.n + len(t.s) > 600 then len(t.s) else f.n + len(t.s) end from fold f join sentences t on t.doc_id = f.doc_id and t.pos = f.pos + 1)
 select doc_id, chunk, string_agg(s, ' ' order by pos) as text from fold group by doc_id, chunk""",
        "l2_normalize": "select vec_id, d::int as dim, round(x / n, 6) as x from (select vec_id, unnest(range(len(embedding))) as d, unnest(embedding)::double as x, sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))) as n from embeddings)",
        "cosine_topk": f"with scored as (select vec_id, label, round({_COS.format('embedding', '(select embedding from embeddings where vec_id = 0)')}, 6) as score from embeddings) select * from scored order by score desc, vec_id limit 10",
        "exact_neighbours": f"""with pairs as (select a.vec_id as query_id, b.vec_id as id, round({_COS.format('a.embedding', 'b.embedding')}, 6) as score from embeddings a join embeddings b on b.vec_id <> a.vec_id where a.vec_id % 100 = 0)
 select query_id, rank::int as rank, id, score from (select *, row_number() over (partition by query_id order by score desc, id) as rank from pairs) where rank <= 10""",
        "centroid_by_label": "select label, d::int as dim, round(avg(x::double), 6) as x from (select label, unnest(range(len(embedding))) as d, unnest(embedding) as x from embeddings) group by all",
        "mmr_select": _mmr(),
        "hybrid_rrf": f"""with {DOCS}, words as (select id, row_number() over ({NEWEST}) as rank from docs where {FOUND}), scored as (select vec_id as id, round({_COS.format('embedding', '(select embedding from embeddings where vec_id = 0)')}, 6) as score from embeddings),
 near as (select id, row_number() over (order by score desc, id) as rank from scored)
 select id, round(sum(1.0::double / (60 + rank)), 9) as score from (select * from words where rank <= 50 union all select * from near where rank <= 50) group by id""",
        "fuzzy_search": f"with {DOCS}, {OWN} select id, eli, score, marks from ({_scored('Thation')}) where score is not null",
        "fallback_merge": f"with {DOCS}, {OWN}, scored as ({_scored('thanti')}) {_fallback('thanti', 'scored')}",
        "fallback_cases": f"""with {DOCS}, {OWN}, one as ({_scored('q')}), two as ({_scored('NN 5/1994')}) select 'direct' as asked, * from ({_fallback('q', 'one')}) union all select 'issue', * from ({_fallback('nn 5/1994', 'two')})
 union all select 'blank', eli, (row_number() over (order by datum desc, eli))::int, null, 0, '' from (select * from own where vrsta = 'en' order by datum desc, eli limit 20)""",
        "suggest_fallback": f"with {DOCS}, {OWN} select eli, naslov from ({_scored('ereathand')}) where score is not null order by score desc, datum desc, eli limit 8",
        "enrich_results": docs + f"select (row_number() over ({NEWEST}))::int as place, eli, naslov, vrsta, izdanje, datum, null::double as match_score, 'lexical' as match_type from (select * from docs where {FOUND} {NEWEST} limit 20)",
        "search_highlights": docs + "select id, array_to_string(regexp_extract_all(doc_cleaned, '(?i)tion')[1:3], '|') as marks from docs",
        "search_index": f"with {INDEX} select * from idx",
        "index_manifest": _manifest(),
        "latest_documents": f"with {INDEX} select eli, datum, naslov from idx order by datum desc, eli limit 6",
        "upsert_documents": f"""with {DOCS}, top as (select max(id) as m from docs) select id, eli, coalesce('label-' || quality, vrsta) as vrsta, naslov from docs left join labels on doc_id = id
 union all select m + row_number() over (order by page_id), '/eli/pages/' || lpad(page_id::varchar, 12, '0'), 'page', url from pages, top""",
        "import_store": rf"""with {DOCS}, kept as (select * from docs where id % 50 <> 7), ls as (select id, unnest(range(len(l)))::int as p, unnest(l) as x from (select id, string_split(doc_cleaned, chr(10)) as l from kept)),
 placed as (select id, row_number() over (partition by id order by p) - 1 as o, 'Član ' || p || '.' as label, regexp_replace(x, '^\s+|\s+$', '', 'g') as text from ls where regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''),
 seg as (select p.id, o, case when o = 0 and doc_id is not null then 'Nov' else label end as label, text from placed p left join labels on doc_id = p.id
  union all select k.id, 0, 'Nov', 'novi tekst' from kept k join labels on doc_id = k.id where k.id not in (select id from placed)),
 per as (select id, count(*) as n, sha256(string_agg(o || '|' || label || '|' || text, chr(10) order by o)) as digest from seg group by id)
 select eli, coalesce('label-' || quality, naslov) as naslov, coalesce(n, 0) as n_segments, digest, nullif(naslov, '') as short, case when naslov <> '' then case when quality is not null then '' else 'm' end end as model_name,
 vrsta as subjects, (vec_id is not null)::bigint as n_vectors, case when vec_id is not null then 64 end::bigint as dim from kept k left join labels l on l.doc_id = k.id left join per using (id) left join embeddings on vec_id = k.id""",
        "delete_cascade": f"with {LINES}, gone as (select doc_id from labels where toxic = 1) select 'documents' as name, count(*) as n from documents where doc_id not in (select doc_id from gone) union all select 'document_segments', count(*) from lines where doc_id not in (select doc_id from gone)",
        "incremental_skip": docs + "select id, eli from docs where id not in (select doc_id from labels)",
        "unique_violations": "select source, left(sha256(text), 12) as h, count(*) as n from documents group by all having count(*) > 1",
        "stage_counters": docs + "select case when trim(doc_cleaned) = '' then 'skipped' when try_strptime(rtrim(datum, '.'), '%d.%m.%Y') is null then 'error' else 'processed' end as status, count(*) as n from docs group by all",
        "eval_prf": """with c as (select lang, count(*) filter (n_chars > 1500 and quality = 1) as tp, count(*) filter (n_chars > 1500 and quality <> 1) as fp, count(*) filter (n_chars <= 1500 and quality = 1) as fn, count(*) filter (n_chars <= 1500 and quality <> 1) as tn from labels join documents using (doc_id) group by lang),
 s as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from c)
 select lang, tp, fp, fn, tn, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from s""",
        "eval_separation": f"""with pairs as (select {_COS.format('a.embedding', 'b.embedding')} as s, a.label = b.label as same from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
 select round(avg(s), 6) as mean_all, round(avg(s) filter (same), 6) as mean_similar, round(avg(s) filter (not same), 6) as mean_dissimilar, round(avg(s) filter (same) - avg(s) filter (not same), 6) as separation from pairs""",
    }
