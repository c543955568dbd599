"""DuckDB SQL for the registered queries, over the driver tables only."""

from checks.corpus_oracles import ORACLES as CORPUS_ORACLES
from pagemill.schemas import CATEGORY_URL

_URL = CATEGORY_URL.removesuffix("%s")

# Fixture views; a query names the ones it needs.
_VIEWS = {
    "placed": """
        select *, (rnk // 30 + 1)::int as page, (rnk % 30)::int as pos
        from (select *,
                (case when o_orderkey % 3 = 0 then 1
                      else 2 + ((o_orderkey // 3) * 2 + o_orderkey % 3 - 1) % 10 end)::int as id,
                case when o_orderkey % 3 = 0 then o_orderkey // 3
                     else ((o_orderkey // 3) * 2 + o_orderkey % 3 - 1) // 10 end as rnk
              from orders)""",
    "catalog": """
        select id, page,
          concat('Drug ', o_custkey::varchar, case when o_custkey % 5 = 0 then ' & Co <é>' else '' end) as drug,
          concat('#/item/?a=1&k=', o_orderkey::varchar) as link,
          o_orderpriority as company,
          case when o_orderkey % 500 = 0 then null
               when o_orderstatus = 'P' then concat('C', o_custkey::varchar)
               else concat('P', o_orderkey::varchar) end as protocol,
          strftime(o_orderdate, '%d/%m/%Y') as pub_date,
          (case when page % 3 = 0 then 1 else 0 end)::int as batch, pos
        from placed""",
    "page_counts": "select id, page, count(*) as n from catalog group by id, page",
    "found_counts": """
        select id, page, count(*) filter (where o_totalprice >= 450000) as n from placed group by id, page""",
    "sizes": "select id, max(page)::int as last_page, sum(n)::bigint as rows from page_counts group by id",
    "crawled": """
        select (case when id = 7 then 12 else id end)::int as id, 30::int as items_page, last_page,
          (rows + case when id = 1 then -10 when id = 2 then 10 else 0 end)::bigint as size
        from sizes""",
    "progress": """
        select (user_id % 11 + 1)::int as category_id,
          (case when user_id % 11 = 1 then 20 else 1 + event_id % 19 end)::int as current_page,
          20::int as last_page,
          (case when user_id % 11 = 2 then 29 else 30 end)::int as saved_size,
          ts, event_id as seq
        from events""",
    "domain": "select unnest(range(1, 13))::int as id",
    "measured": """
        select d.id, (case when s.id is null then 0 else 30 end)::int as items_page,
          coalesce(s.last_page, 0)::int as last_page, coalesce(s.rows, 0)::bigint as size
        from domain d left join sizes s on d.id = s.id""",
    # Old rows (batch 0) first, then new ones; the last row of a protocol stays.
    "merged": """
        select id, page, drug, link, company, protocol, pub_date, batch, pos
        from (select *, row_number() over (partition by protocol order by batch desc, id desc, page desc, pos desc) as rn
              from catalog)
        where rn = 1""",
    "latest": """
        select category_id, current_page, last_page, saved_size, ts, seq
        from (select *, row_number() over (partition by category_id order by ts desc, seq desc) as rn from progress)
        where rn = 1""",
}
_NEEDS = {
    "placed": [],
    "catalog": ["placed"],
    "page_counts": ["catalog"],
    "found_counts": ["placed"],
    "sizes": ["page_counts"],
    "crawled": ["sizes"],
    "progress": [],
    "domain": [],
    "measured": ["domain", "sizes"],
    "merged": ["catalog"],
    "latest": ["progress"],
}
_COLUMNS = "id, page, drug, link, company, protocol, pub_date, batch, pos"


def _with(names: list[str], body: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS[name]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{n} as ({_VIEWS[n]})" for n in ordered) + "\n" + body


_STATUS = """case when expected is null then 'no_metadata'
    when found = 0 and expected > 0 then 'no_local'
    when found < expected then 'missing' when found > expected then 'excess' else 'complete' end"""


def _completeness(local: str, metadata: str) -> str:
    return f"""
        select id, expected, found, expected - found as diff, {_STATUS} as status
        from (select coalesce(m.id, l.id) as id, m.size as expected, coalesce(l.found, 0) as found
              from {metadata} m full outer join (select id, count(*) as found from {local} group by id) l on m.id = l.id)"""


ORACLES = {
    "extract_listing_rows": _with(["catalog"], f"select {_COLUMNS} from catalog"),
    "malformed_rows": _with(["page_counts"], 'select id, page, (n + 1)::int as "row", 1::int as found from page_counts'),
    "page_states": _with(
        ["sizes"],
        """select p.id, p.page as page, p.page as current, least(p.page + 1, s.last_page)::int as next,
             s.last_page as last, 30::int as items_page
           from page_counts p join sizes s on p.id = s.id""",
    ),
    "numeric_guard": r"""
        select page_id, segment, regexp_full_match(segment, '[0-9]+') as valid,
          case when regexp_full_match(segment, '[0-9]+') then try_cast(segment as int) end as number
        from (select page_id, regexp_extract(url, '^[^?#]*/([^/?#]+)', 1) as segment from pages)""",
    "parse_pub_date": _with(
        ["catalog"], "select link, pub_date, try_strptime(pub_date, '%d/%m/%Y')::date as pub_day from catalog"
    ),
    "json_field": "select event_id, json_extract_string(props, '$.k') as k from events",
    "normalize_space": r"""
        select doc_id, md5(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ')) as digest from documents""",
    "strip_text": r"""
        select conv_id, turn,
          nullif(regexp_replace(text, '^[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g'), '') as stripped
        from conversations""",
    "run_stamp": "select event_id, strftime(ts, '%Y%m%d%H%M%S') as stamp from events",
    "next_page": _with(
        ["progress"],
        """select seq, current_page, last_page,
             (case when current_page < last_page then current_page + 1 else last_page end)::int as next_page
           from progress""",
    ),
    "category_url": _with(["crawled"], f"select id, concat('{_URL}', id::varchar) as url from crawled"),
    "write_chunks": _with(["page_counts"], "select id, page, n from page_counts"),
    "scan_chunks": _with(["catalog"], f"select {_COLUMNS} from catalog"),
    "prune_category": _with(["catalog"], f"select {_COLUMNS} from catalog where id <> 3"),
    "merge_keep_last": _with(["merged"], "select * from merged"),
    "overwrite_catalog": _with(["catalog"], f"select {_COLUMNS} from catalog where batch = 1"),
    "duplicate_members": _with(
        ["catalog"],
        f"select {_COLUMNS} from (select *, count(*) over (partition by protocol) as c from catalog) where c > 1",
    ),
    "merge_report": _with(
        ["merged"],
        """select c.id, c.rows_in, coalesce(m.kept, 0) as rows_kept, c.rows_in - coalesce(m.kept, 0) as dropped, c.null_protocols
           from (select id, count(*) as rows_in, count(*) filter (where protocol is null) as null_protocols
                 from catalog group by id) c
           left join (select id, count(*) as kept from merged group by id) m on c.id = m.id""",
    ),
    "upsert_keep_last": _with(["merged"], "select * from merged"),
    "write_catalog": _with(
        ["merged"],
        """select id, page, drug, concat(chr(9), ' ', link, '  ') as link, company, protocol, pub_date, format
           from merged, (select unnest(['parquet', 'csv']) as format)""",
    ),
    "duplicates_report": _with(
        ["catalog"],
        f"select {_COLUMNS} from (select *, count(*) over (partition by protocol) as c from catalog) where c > 1",
    ),
    "latest_snapshot": _with(["crawled"], "select * from crawled"),
    "rows_per_page": _with(["page_counts"], "select id, page, n from page_counts"),
    "rows_per_category": _with(
        ["page_counts"], "select id, count(*) as pages, sum(n)::bigint as size from page_counts group by id"
    ),
    "volume_estimate": _with(
        ["found_counts"],
        """select id, max(page) as last_page,
             ((max(page) - 1) * coalesce(max(n) filter (where page = 1), 0) + arg_max(n, page))::bigint as size
           from found_counts group by id""",
    ),
    "crawl_metadata": _with(["measured"], "select id, items_page, last_page, size from measured"),
    "empty_categories": _with(["measured"], "select id from measured where size = 0"),
    "crawled_filter": _with(["crawled"], "select * from crawled where id = 2"),
    "eligible_categories": _with(["crawled", "domain"], "select id from domain where id in (select id from crawled)"),
    "completeness_by_category": _with(["catalog", "crawled"], _completeness("catalog", "crawled")),
    "completeness_global": _with(
        ["catalog", "crawled"],
        """select expected, found, expected - found as diff,
             case when expected is null then 'no_metadata' when found = 0 and expected > 0 then 'no_local'
                  when found < expected then 'missing' when found > expected then 'excess' else 'complete' end as status
           from (select (select sum(size)::bigint from crawled) as expected, (select count(*) from catalog) as found)""",
    ),
    "progress_entries": _with(
        ["page_counts"],
        """select '20240101000000' as timestamp, id as category_id, page as current_page,
             max(page) over (partition by id) as last_page, n::int as saved_size from page_counts""",
    ),
    "last_progress": _with(["latest"], "select * from latest"),
    "resume_plan": _with(
        ["crawled", "latest"],
        """select id, action,
             (case action when 'skip' then null
                   when 'resume' then case when current_page < logged_last then current_page + 1 else logged_last end
                   else 1 end)::int as start_page
           from (select c.id, l.current_page, l.last_page as logged_last,
                   case when l.category_id is null then 'fresh'
                        when l.current_page = l.last_page then 'skip'
                        when l.saved_size <> c.items_page then 'restart'
                        else 'resume' end as action
                 from crawled c left join latest l on c.id = l.category_id)""",
    ),
    "missing_pages": _with(
        ["crawled", "found_counts"],
        """select w.id, w.page from (select id, unnest(range(1, last_page + 1))::int as page from crawled) w
           where not exists (select 1 from found_counts f where f.id = w.id and f.page = w.page and f.n > 0)""",
    ),
    "stalled_pages": _with(
        ["progress"],
        """select category_id, current_page, last_page, saved_size, ts, seq
           from (select * replace (nullif(category_id, 5) as category_id),
                   lag(current_page) over (partition by category_id order by seq) as previous from progress)
           where previous = current_page""",
    ),
    "contiguous_prefix": _with(
        ["found_counts"],
        """, f as (select id, page, n from found_counts
             union all select case when id <> 2 then id + 100 end, page, n from found_counts)
           select f.id, f.page, f.n from f
           left join (select id, min(page) as stop from f where n = 0 group by id) s on f.id is not distinct from s.id
           where s.stop is null or f.page < s.stop""",
    ),
    # Nothing was saved before, so the first harvest keeps all rows as they are.
    "harvest_run": _with(["catalog"], f"select {_COLUMNS} from catalog"),
    "harvest_check": _with(["merged", "measured"], _completeness("merged", "measured")),
    "harvest_force": _with(["catalog"], f"select {_COLUMNS} from catalog"),
    "harvest_crawl_only": _with(["measured"], "select id, items_page, last_page, size from measured"),
    "check_category": _with(
        ["catalog", "measured"], f"select * from ({_completeness('catalog', 'measured')}) where id in (1, 2, 12)"
    ),
    "consolidate_replay": _with(["merged"], "select * from merged"),
    "relanded_pages": _with(
        ["catalog"],
        """select id, page, case when page % 2 = 0 then 'Re' || lower(drug[1]) || drug[2:] else drug end as drug, link, company,
             protocol, pub_date, case when id <> 3 then batch end as batch, pos, way
           from catalog, (select unnest(['batch', 'stream']) as way)""",
    ),
    "stream_upsert": _with(["merged"], "select * from merged"),
    "assemble_chat": """
        with turns as (
          select conv_id, turn, role, text from conversations
          union all select -1 - conv_id // 20, conv_id % 20 * 1000 + turn, role, text from conversations)
        select conv_id, count(*)::int as n_messages,
          to_json(list(struct_pack(role := role, content := text) order by turn, role, text))::varchar as messages
        from turns group by conv_id""",
    "harvest_report": _with(["merged", "measured"], _completeness("merged", "measured")),
} | CORPUS_ORACLES
