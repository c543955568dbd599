"""DuckDB SQL for the queries of ``corpus_queries``."""

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NAME_WORD = r"[^\x20\x09-\x0D.,;:!?]+"
_SPACES = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_CAPITALS}', '{_SMALL}'), '{_NAME_WORD}')"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


def _mark(key: str) -> str:
    return f"('0x' || substr(md5(coalesce({key}::varchar, '')), 1, 15))::bigint"


_TRUE = """
nearest as (
  select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) as score
  from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0
  qualify row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.e, v.e), 9) desc, v.vec_id) <= 10
)"""
_UNITS = """
v as (
  select distinct vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
)"""

# A page without comments, scripts and styles.
_VISIBLE = r"regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>', '<!>', 'g')"
_BLOCKS = (
    "address|article|aside|blockquote|body|br|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|"
    "li|main|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul"
)


def _decoded(text: str) -> str:
    """The entities that the pages have."""
    for entity, sign in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{sign}')"
    return text


def _one_line(markup: str) -> str:
    spaced = f"regexp_replace({_decoded(f'''regexp_replace({markup}, '<(?:![^>]*|/?[A-Za-z][^>]*)>', '', 'g')''')}, '[ \\t\\r\\n]+', ' ', 'g')"
    return _strip(spaced)


_LINES = rf"""
seen as (select page_id, url, {_VISIBLE} as v from pages),
body as (select page_id, url, regexp_replace(regexp_replace(v, '(?is)<head[\s>].*?</head\s*>', ''), '[ \t\r\n\f]+', ' ', 'g') as b from seen),
cut as (
  select page_id, url, string_split({_decoded(f"regexp_replace(regexp_replace(b, '(?i)</?(?:{_BLOCKS})(?:[ /][^>]*)?>', chr(10), 'g'), '<(?:![^>]*|/?[A-Za-z][^>]*)>', '', 'g')")}, chr(10)) as l
  from body
),
page_lines as (
  select page_id, url, list_filter(list_transform(l, lambda x: {_strip("regexp_replace(x, '[ ' || chr(9) || chr(13) || ']+', ' ', 'g')")}), lambda x: x <> '') as l from cut
)"""


def _boilerplate(kind: str, rows: str, least: int, percent: int) -> str:
    """Texts (id, grp, text) without the lines common in their group."""
    return f"""
{kind}_t as (select row_number() over () as k, * from ({rows})),
{kind}_l as (select k, grp, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip("x")}), lambda x: x <> ''))) as line from {kind}_t),
{kind}_c as (
  select grp, line from (select grp, line, count(*) as n from {kind}_l group by all) c
  where n >= {least} and n * 100 >= {percent} * (select count(*) from {kind}_t t where t.grp is not distinct from c.grp)
),
{kind}_g as (select grp, list(line) as common from {kind}_c group by grp),
{kind}_k as (
  select id, text, string_split(text, chr(10)) as l,
    list_filter(string_split(text, chr(10)), lambda x: not list_contains(coalesce(common, []), {_strip("x")})) as kept
  from {kind}_t t left join {kind}_g g on g.grp is not distinct from t.grp
)"""


def _boilerplate_rows(kind: str) -> str:
    return f"select '{kind}' as kind, id, (coalesce(len(l), 0) - coalesce(len(kept), 0))::int as n_dropped, md5(array_to_string(kept, chr(10))) as digest from {kind}_k"


_EDGES = """
m as (select l_orderkey as s, l_linenumber as p, l_partkey as x from lineitem),
e as (
  select least(a.x, b.x) as a, greatest(a.x, b.x) as b, count(*) as weight from m a join m b on a.s = b.s
  where a.x <> b.x and b.p - a.p <= 3 and (b.p > a.p or b.p = a.p and a.x < b.x) group by all
),
w as (select a as node, b as other, weight from e union all select b, a, weight from e)"""

_CONTAINED = f"""
i as (select item_id, {_words("text")} as w from benchmark where item_id is not null and text is not null),
iw as (
  select distinct item_id, unnest(case when len(w) = 0 then [] when len(w) < 8 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' ')) end) as g from i
),
d as (select row_number() over () as k, doc_id, text, {_words("text")} as w from documents),
dw as (
  select distinct k, doc_id, unnest(case when len(w) = 0 then [] when len(w) < 8 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' ')) end) as g from d where text is not null
),
n as (select item_id, count(*) as n_windows from iw group by 1),
found as (
  select k, doc_id, item_id, n_common, n_windows from (
    select k, doc_id, item_id, count(*) as n_common from dw join iw using (g) group by all
  ) join n using (item_id) where n_common * 100 >= n_windows * 80
)"""

_RULES = {
    "no_id": "doc_id is null",
    "no_text": "text is null",
    "blank_text": f"{_strip('text')} = ''",
    "wrong_length": "n_chars <> length(text)",
    "unknown_language": "coalesce(lang, '') not in ({languages})",
    "control_signs": r"regexp_matches(text, '[\x00-\x08\x0E-\x1F\x7F]')",
    "replaced_signs": "contains(text, chr(65533))",
}


def _rule(name: str, *languages: str) -> str:
    return _RULES[name].replace("{languages}", ", ".join(f"'{x}'" for x in languages))


def _psi(bins: int = 10) -> str:
    cuts = ", ".join(f"quantile_disc(value, {k / bins}) as c{k}" for k in range(1, bins))
    low = ["0", *(f"count(*) filter (value <= c{k})" for k in range(1, bins)), "count(*)"]
    bases = ["0", *(f"count_if(value <= c{k})" for k in range(1, bins)), "count(*)"]
    share = lambda x, y: f"(({y}) - ({x}) + 0.5) / (count(*) + {0.5 * bins})"
    now = [share(x, y) for x, y in zip(low, low[1:], strict=False)]
    base = [share(x, y) for x, y in zip(bases, bases[1:], strict=False)]
    terms = " + ".join(f"(p{k} - b{k}) * ln(p{k} / b{k})" for k in range(bins))
    return f"""
with e as (select event_type, date_trunc('week', ts)::date as week, value from events where ts is not null and value is not null and isfinite(value)),
f as (select event_type, min(week) as first from e group by 1),
c as (select e.event_type, {cuts} from e join f on e.event_type is not distinct from f.event_type and week = first group by 1),
b as (
  select e.event_type, {", ".join(f"{x} as b{k}" for k, x in enumerate(base))}
  from e join f on e.event_type is not distinct from f.event_type and week = first join c on c.event_type is not distinct from e.event_type group by 1
),
p as (
  select e.event_type, week, count(*) as n, {", ".join(f"{x} as p{k}" for k, x in enumerate(now))}
  from e join c on c.event_type is not distinct from e.event_type group by 1, 2
)
select p.event_type, week, n, round({terms}, 6) as psi from p join b on p.event_type is not distinct from b.event_type"""


ORACLES = {
    "vector_topk": f"""
with {_UNITS}, {_TRUE}
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from nearest""",
    "vector_index_recall": f"""
with {_UNITS}, {_TRUE}
select count(distinct query_id) as n_queries, count(*) as n_neighbours, true as recall_reached from nearest""",
    "resolve_entities": f"""
with n as (
  select name, count(*) as n from (
    select array_to_string({_words("x")}, ' ') as name from (select s_name as x from supplier union all select c_name from customer)
  ) where name <> '' group by 1
)
select a.name as name_a, b.name as name_b, levenshtein(a.name, b.name)::int as distance, a.n as n_a, b.n as n_b
from n a join n b on a.name < b.name where levenshtein(a.name, b.name) <= 1""",
    "dictionary_entities": f"""
with recursive names as (
  select distinct w, len(w) as size, w[1] as first from (
    select {_words("p_name")} as w from part union all select ({_words("text")})[1:k] from benchmark, (values (1), (2), (3)) as t(k)
  ) where len(w) > 0
),
d as (select row_number() over () as k, doc_id, {_words("text")} as w from documents),
p as (select k, unnest(range(len(w))) as start, unnest(w) as x1 from d),
n as (select k, start, x1, lead(x1) over r as x2, lead(x1, 2) over r as x3, lead(x1, 3) over r as x4 from p window r as (partition by k order by start)),
hits as materialized (
  select k, start, max(size) as size from n join names on first = x1
  where w = [x1, x2, x3, x4][1:size] group by k, start
),
walk as (
  select k, min(start) as start from hits group by k
  union all
  select h.k, h.start from (
    select w.k, (select min(n.start) from hits n where n.k = w.k and n.start >= w.start + h.size) as start
    from walk w join hits h on h.k = w.k and h.start = w.start
  ) h where h.start is not null
)
select doc_id, start::int as start, size::int as size, array_to_string(d.w[start + 1:start + size], ' ') as entity
from walk join hits using (k, start) join d using (k)""",
    "monitor_daily": """
select ts::date as day, event_type, count(*) as n, sum(value::decimal(18, 2))::decimal(28, 2) as total, max(ts) as last
from events where ts is not null group by 1, 2""",
    "drift_psi": _psi(),
    "page_title": rf"""
with seen as (select page_id, {_VISIBLE} as v from pages)
select page_id, nullif({_one_line(r"regexp_extract(v, '(?is)<title[^>]*>(.*?)</title', 1)")}, '') as title from seen""",
    "page_text": f"""
with {_LINES}
select page_id, len(l)::int as n_lines, md5(array_to_string(l, chr(10))) as digest from page_lines""",
    "page_links": rf"""
with seen as (select page_id, {_VISIBLE} as v from pages),
a as (select page_id, regexp_extract_all(v, '(?is)<a[\s>].*?</a') as l from seen),
b as (select page_id, unnest(range(len(l)))::int as pos, unnest(l) as x from a)
select page_id, pos, case when regexp_matches(x, '(?is)^<a[^>]*\shref\s*=') then {_strip(_decoded(r"regexp_extract(x, '(?is)^<a[^>]*\shref\s*=\s*\x22([^\x22]*)\x22', 1)"))} end as href,
  {_one_line(r"regexp_replace(regexp_replace(x, '(?is)</a$', ''), '(?is)^<a[^>]*>', '')")} as text
from b""",
    "drop_boilerplate_lines": rf"""
with {_LINES},
{_boilerplate("page", r"select page_id as id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') as grp, array_to_string(l, chr(10)) as text from page_lines", 2, 30)},
{_boilerplate("document", "select doc_id as id, lang as grp, text from documents", 3, 1)}
{_boilerplate_rows("page")} union all {_boilerplate_rows("document")}""",
    "cooccurrence_edges": f"""
with {_EDGES}
select node, row_number() over (partition by node order by weight desc, other)::int as rank, other, weight from w qualify rank <= 5""",
    "cooccurrence_nodes": f"with {_EDGES} select node, count(*) as n_edges, sum(weight)::bigint as weight from w group by 1",
    "contained_items": f"with {_CONTAINED} select doc_id, item_id, n_common, n_windows from found",
    "decontaminate": f"with {_CONTAINED} select doc_id, md5(text) as digest from d where k not in (select k from found)",
    "balance_by_source": f"""
select doc_id, source from documents qualify row_number() over (partition by source order by {_mark("doc_id")}) <= 20""",
    "domain_shares": "select source, lang, count(*) as n, round(count(*) / (select count(*) from documents), 6) as share from documents group by 1, 2",
    "corpus_checks": f"""
{" union all ".join(f"select '{r}' as rule, count(*) as checked, count_if(coalesce({_rule(r, 'en', 'de', 'fr', 'es')}, false))::bigint as broken from documents" for r in _RULES)}
union all select 'repeated_id', sum(n)::bigint, coalesce(sum(n) filter (doc_id is not null and n > 1), 0)::bigint
  from (select doc_id, count(*) as n from documents group by 1)
union all select 'label_without_document', count(*), count_if(not exists (from documents d where d.doc_id = l.doc_id))::bigint from labels l""",
    "quarantined_documents": f"""
select doc_id, reasons from (
  select doc_id, concat_ws(',', {", ".join(f"case when {_rule(r, 'en')} then '{r}' end" for r in _RULES)}) as reasons from documents
) where reasons <> ''""",
    "cross_source_join": """
with s as (select regexp_extract(s_name, '#0*([0-9]+)$', 1)::bigint as number, s_nationkey as nation, case when s_acctbal >= 0 then s_acctbal end as balance from supplier),
c as (select regexp_extract(c_name, '#0*([0-9]+)$', 1)::bigint as number, case when c_nationkey > 4 then c_nationkey end as nation,
  c_acctbal as balance, c_mktsegment as segment from customer)
select number, coalesce(s.nation, c.nation) as nation, case when s.nation is not null then 'supplier' when c.nation is not null then 'customer' end as nation_from,
  coalesce(s.balance, c.balance) as balance, case when s.balance is not null then 'supplier' when c.balance is not null then 'customer' end as balance_from,
  segment, case when segment is not null then 'customer' end as segment_from,
  (s.number is not null)::bigint + (c.number is not null)::bigint as n_sources
from s full join c using (number)""",
    "cross_source_merge": """
select regexp_extract(s_name, '#0*([0-9]+)$', 1)::bigint as number, s_nationkey as nation, case when s_acctbal >= 0 then s_acctbal end as balance,
  null::varchar as segment, 'supplier' as source from supplier
union all select regexp_extract(c_name, '#0*([0-9]+)$', 1)::bigint, case when c_nationkey > 4 then c_nationkey end, c_acctbal, c_mktsegment, 'customer' from customer""",
    "error_first_line": r"""
select doc_id, md5(regexp_extract(text, '^[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*')) as digest from documents""",
}
