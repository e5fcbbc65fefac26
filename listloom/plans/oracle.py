"""The queries in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from ..sources import fixtures as X

# Fixed values, written out here so that the SQL checks those of the code.
_RESERVED = ("localhost", "localhost.localdomain", "broadcasthost", "local")
_SIGNATURES = (
    "[Adblock Plus", "[Adblock", "! Title:", "! Homepage:", "! Last modified:", "# Title:", "# Description:", "# Homepage:", "# Expires:", "# Syntax:", "# Version:",
    "# License:", "# Number of entries:", "#Number of Entries:", "# Last Updated:", "#Last Updated:", "Created using", "0.0.0.0 ", "0.0.0.0\t", "127.0.0.1 ", "127.0.0.1\t", "||", "@@||",
)
_HOSTING = (".githubusercontent.com", ".github.io", ".jsdelivr.net", ".gitlab.io")
_ENDINGS = (".txt", ".csv", ".hosts", ".list", ".php")
_SKIPPED_PARTS = ("raw", "master", "main", "latest", "refs", "heads", "gh", "download", "downloads", "extension")
_TYPES = ("text/html", "application/json", "application/xml", "text/xml")
_TYPE_STARTS = ("image/", "video/", "audio/", "application/zip", "application/pdf")

_TABLES = {"lineitem": "lineitem", "events": "events", "pages": "pages", "supplier": "supplier"}
_IP = "'^(0\\.0\\.0\\.0|127\\.0\\.0\\.1)[ \t]'"


def _listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _starts(column: str, values) -> str:
    return "(" + " or ".join(f"starts_with({column}, '{v}')" for v in values) + ")"


_SKIPPED = "(line = '' or regexp_matches(line, '^(#|!|@@)') or (regexp_matches(line, '[$/\\\\*]') and not starts_with(line, '||')))"
_COMMENT = "((starts_with(line, '! ') or starts_with(line, '# ')) and not contains(line, '##'))"
_SCRIPTLET = "(contains(line, '##+js(') or contains(line, '#%#//scriptlet('))"
_COSMETIC = "(contains(line, '##') and not contains(line, '#@#') and not contains(line, '##+js') and not contains(line, '##^'))"
_ADBLOCK = "case when starts_with(line, '||') and not regexp_matches(substr(line, 3), '[/*?]') then split_part(split_part(substr(line, 3), '^', 1), '$', 1) end"
_HOSTS = f"case when not {_SKIPPED} and regexp_matches(line, {_IP}) then split_part(regexp_split_to_array(line, '\\s+')[2], '#', 1) end"
_PLAIN = f"case when not {_SKIPPED} and not starts_with(line, '||') and not regexp_matches(line, {_IP}) and not regexp_matches(line, '[ \t]') and contains(line, '.') then line end"


def _checked(name: str) -> str:
    low = f"lower(trim({name}))"
    return f"case when {low} <> '' and {low} not in ({_listed(_RESERVED)}) and contains({low}, '.') and not regexp_matches({low}, '^[0-9][0-9.]*$') then {low} end"


_DOMAIN = _checked(f"coalesce({_ADBLOCK}, {_HOSTS}, {_PLAIN})")

WITH: dict[str, str] = {
    "filter_lines": X.FILTER_LINES.format(**_TABLES),
    "dns_queries": X.DNS_QUERIES.format(**_TABLES),
    "lists": "select distinct list_id from filter_lines",
    "trimmed": "select list_id, line_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as line from filter_lines",
    "classified": f"""
        select list_id, line_no, 'scriptlet' as kind, line as text from trimmed where not {_COMMENT} and {_SCRIPTLET}
        union all select list_id, line_no, 'cosmetic', line from trimmed where not {_COMMENT} and not {_SCRIPTLET} and {_COSMETIC}
        union all select list_id, line_no, 'domain', {_DOMAIN} from trimmed where not {_COMMENT} and not {_SCRIPTLET} and {_DOMAIN} is not null""",
    "rules": "select list_id, kind, text, min(line_no) as first_line from classified group by all",
    "domains": "select list_id, text as domain from rules where kind = 'domain'",
    "counted": """select l.list_id, coalesce(domains, 0) as domains, coalesce(cosmetic, 0) as cosmetic, coalesce(scriptlets, 0) as scriptlets, coalesce(domains, 0) as rule_count
        from lists l left join (select list_id, count(*) filter (kind = 'domain') as domains, count(*) filter (kind = 'cosmetic') as cosmetic,
        count(*) filter (kind = 'scriptlet') as scriptlets from rules group by 1) r using (list_id)""",
    "labelled": "select list_id, domain, list_filter(list_reverse(string_split(domain, '.')), lambda x: x <> '') as labels from domains",
    "nodes": """select list_id, path, len(path) as depth, bool_or(whole) as is_terminal from (
        select list_id, list_slice(labels, 1, d) as path, d = len(labels) as whole from (select list_id, labels, unnest(range(0, len(labels) + 1)) as d from labelled)) group by list_id, path""",
    "children": """select list_id, list_slice(path, 1, depth - 1) as path, count(*) as child_count, cast(sum(6 + strlen(path[depth])) as bigint) as child_bytes
        from nodes where depth > 0 group by 1, 2""",
    "laid_out": """select list_id, path, depth, is_terminal, coalesce(child_count, 0) as child_count, row_number() over w - 1 as bfs_index,
        cast(16 + sum(5 + coalesce(child_bytes, 0)) over w - 5 - coalesce(child_bytes, 0) as bigint) as byte_offset
        from nodes left join children using (list_id, path) window w as (partition by list_id order by depth, path)""",
    "hashed": """select list_id, domain, list_reduce(list_prepend(14695981039346656037::hugeint, b), lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616) as h1,
        list_reduce(list_prepend(14695981039346656037::hugeint, b), lambda h, x: xor((h * 1099511628211) % 18446744073709551616, x)) as f1
        from (select list_id, domain, list_transform(range(1, length(domain) + 1), lambda i: ord(substr(domain, i, 1))::hugeint) as b from domains)""",
    "params": "select list_id, count(*) as n, cast(ceil(ceil(count(*) * (-ln(0.001)) / (ln(2) * ln(2))) / 8) * 8 as bigint) as bit_count, 10 as hash_count from domains group by 1",
    "positions": """select list_id, domain, i, cast(((h1 + i * (f1 + case when f1 % 2 = 0 then 1 else 0 end)) % 18446744073709551616) % bit_count as bigint) as pos
        from (select *, unnest(range(0, 10)) as i from hashed join params using (list_id))""",
    "suffixes": """select qname, array_to_string(list_slice(parts, k, len(parts)), '.') as suffix, len(parts) - k + 1 as labels
        from (select qname, parts, unnest(range(1, len(parts) + 1)) as k from (select distinct qname, string_split(qname, '.') as parts from dns_queries))""",
    "match_queries": X.MATCH_QUERIES.format(**_TABLES),
    "match_trimmed": f"select list_id, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as line from ({X.MATCH_LINES.format(**_TABLES)})",
    "match_rules": f"""select labels, bool_or(sec) as sec, bool_or(not sec) as ad from (select list_filter(list_reverse(string_split({_DOMAIN}, '.')), lambda x: x <> '') as labels,
        list_id in ('list_0', 'list_1', 'list_2', 'list_3') as sec from match_trimmed where not {_COMMENT} and not {_SCRIPTLET} and {_DOMAIN} is not null) group by 1""",
    "walked": """select qname, list_slice(labels, 1, k) as labels, k from (select qname, labels, unnest(range(0, len(labels) + 1)) as k from (
        select distinct qname, list_filter(list_reverse(string_split(qname, '.')), lambda x: x <> '') as labels from match_queries where qname is not null))""",
    "met": "select qname, k, labels, sec, ad from walked join match_rules using (labels)",
    "custom": "select qname, cast(min_by(query_id, query_id) % 2 as int) as action from match_queries where query_id % 97 = 0 group by qname",
    "security": "select distinct domain from domains where list_id in ('list_0', 'list_1', 'list_2', 'list_3')",
    "ads": "select distinct domain from domains where list_id not in ('list_0', 'list_1', 'list_2', 'list_3')",
    "catalog": f"""select id, name, url, r2_download_link, rule_count, file_size, timestamp '{X.EPOCH}' + to_hours(age_hours) as last_updated, timestamp '{X.EPOCH}' + to_hours(age_hours) as created_at
        from ({X.CATALOG_SEED.format(**_TABLES)})""",
    "batch": """select name, url, r2_download_link, rule_count + 1 as rule_count, file_size from catalog where id % 3 = 0
        union all select name, concat(url, '#new'), r2_download_link, rule_count, file_size from catalog where id % 10 = 0""",
    "fetch_log": X.FETCH_LOG.format(**_TABLES),
    "seen_log": "select *, coalesce(" + ", ".join(f"try(decode(encode(body_text)[1:{n}]))" + (" || chr(65533)" if n < 16384 else "") for n in range(16384, 16380, -1)) + ") as seen from fetch_log",
    "noise": "select doc_id, i as line_no, regexp_replace(a[i], '^\\s+|\\s+$', '', 'g') as line from (select doc_id, a, unnest(range(1, len(a) + 1)) as i from (select doc_id, string_split(text, chr(10)) as a from documents where text is not null))",
}

_SIGNATURE = f"({_starts('line', _SIGNATURES)} or (contains(line, '##') and not starts_with(line, '#')))"
_LOOKS = f"(not {_SIGNATURE} and line <> '' and not regexp_matches(line, '^[#!]') and contains(line, '.') and not regexp_matches(line, '[ \t]'))"
WITH["body_lines"] = f"""select page_id, i, regexp_replace(a[i], '^\\s+|\\s+$', '', 'g') as line from (select page_id, a, unnest(range(1, least(len(a), 300) + 1)) as i
    from (select page_id, string_split(seen, chr(10)) as a from seen_log))"""
WITH["verdict"] = f"""select f.page_id, f.url, coalesce(has_signature, false) as has_signature, coalesce(plain_lines, 0) as plain_lines, coalesce(has_signature or plain_lines >= 3, false) as is_list
    from fetch_log f left join (select page_id, bool_or({_SIGNATURE}) as has_signature, cast(count(*) filter ({_LOOKS}) as int) as plain_lines from body_lines group by 1) using (page_id)"""
_KIND = "case when contains(lower(content_type), ';') then trim(split_part(lower(content_type), ';', 1)) else lower(content_type) end"
_BAD_TYPE = f"({_KIND} in ({_listed(_TYPES)}) or {_starts(_KIND, _TYPE_STARTS)})"
_HTML = "regexp_matches(lower(regexp_replace(seen, '^\\s+', '')), '^<(!doctype|html|head)')"

_REST = "regexp_replace(url, '(?s)#.*$', '')"
_URL = "'(?s)^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?]*)([^?]*)'"
_AUTHORITY = f"regexp_extract({_REST}, {_URL}, 1)"
_HOST = f"lower(regexp_replace({_AUTHORITY}, '^.*@', ''))"
_BROKEN = "'%($|[^0-9A-Fa-f]|[0-9A-Fa-f]($|[^0-9A-Fa-f]))'"
#: Of the ways in which a URL can be malformed those that the fixture has.
_MALFORMED = f"(regexp_matches(regexp_extract({_REST}, {_URL}, 2), {_BROKEN}) or regexp_matches(regexp_extract(url, '#(.*)$', 1), {_BROKEN}) or regexp_matches({_HOST}, ':[^:]*[^0-9:]') or regexp_matches({_HOST}, '[ %]') or {_HOST} = '')"
_SHORT = _HOST
for _p in ("^www\\.", "^raw\\.", "^cdn\\."):
    _SHORT = f"regexp_replace({_SHORT}, '{_p}', '')"
_SHORT = f"regexp_replace({_SHORT}, '(" + "|".join(h.replace(".", "\\.") for h in _HOSTING) + ")$', '')"
_SHORT = f"regexp_replace({_SHORT}, '^(.+)\\.[^.]*$', '\\1')"
_PATH = f"string_split(lower(trim(regexp_extract({_REST}, {_URL}, 2), '/')), '/')"
_SEGMENT = "x"
for _e in _ENDINGS:
    _SEGMENT = f"regexp_replace({_SEGMENT}, '\\{_e}$', '')"
_PARTS = f"list_filter(list_transform({_PATH}, lambda x: {_SEGMENT}), lambda x: x <> '' and x not in ({_listed(_SKIPPED_PARTS)}))"
WITH["named"] = f"select page_id, url, translate({_SHORT}, '.-', '__') as owner, {_PARTS} as parts, {_MALFORMED} as malformed from urls"
WITH["urls"] = X.URLS.format(**_TABLES)


def with_(*names: str, landed: bool = False) -> str:
    """A WITH clause with the named views and all that they need, in order; with `landed` over the landed lines."""
    views = dict(WITH)
    if landed:
        lines = X.LANDED_LINES.format(**_TABLES)
        views["filter_lines"] = f"select * from ({lines}) where list_id not in (select list_id from ({lines}) group by 1 having max(strlen(raw)) >= 1048576)"
        views["lists"] = f"select distinct list_id from ({lines})"
    need: set[str] = set()

    def add(name: str) -> None:
        if name not in need:
            need.add(name)
            for other in views:
                if other != name and any(f"{k} {other}" in " ".join(views[name].split()) for k in ("from", "join")):
                    add(other)

    for n in names:
        add(n)
    return "with " + ", ".join(f"{n} as ({q})" for n, q in sorted(views.items(), key=lambda v: _ORDER.index(v[0])) if n in need) + " "


#: Views with all that they need before them.
_LATE = ("urls", "named")
_ORDER = [n for n in WITH if n not in _LATE] + list(_LATE)
_MANIFEST = """
        select list_id, 'trie' as entry, cast(16 + sum(5 + coalesce(child_bytes, 0)) as bigint) as n_bytes from nodes left join children using (list_id, path) group by 1
        union all select list_id, 'bloom', 24 + bit_count // 8 from params
        union all select list_id, case kind when 'cosmetic' then 'css' else 'scriptlets' end, cast(sum(strlen(text) + 1) as bigint) from rules where kind <> 'domain' group by 1, kind
        union all select list_id, 'info.json', strlen('{{"name":"' || list_id || '","url":"{0}' || list_id || '","ruleCount":' || rule_count || ',"updatedAt":"2024-06-01T00:00:00Z"}}')
        from counted where domains + cosmetic + scriptlets > 0"""
_BASE = "https://lists.example.com/"
_MANIFEST_VIEWS = ("laid_out", "children", "params", "rules", "counted")
_BITS = "select list_id, pos // 8 as byte_idx, bit_or((1 << (pos % 8))::int) as byte_val from positions group by 1, 2"
_FNV = """list_reduce(list_prepend(14695981039346656037::hugeint, b), lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616) as h1,
        list_reduce(list_prepend(14695981039346656037::hugeint, b), lambda h, x: xor((h * 1099511628211) % 18446744073709551616, x)) as f1"""
_BYTES = "list_transform(range(1, length({0}) + 1), lambda i: ord(substr({0}, i, 1))::hugeint) as b"
WITH["each_list"] = "select list_id, domain from domains union all select 'all', domain from (select distinct domain from domains)"
WITH["each_size"] = "select list_id, cast(ceil(ceil(count(*) * (-ln(0.001)) / (ln(2) * ln(2))) / 8) * 8 as bigint) as bit_count from each_list group by 1"
WITH["rule_hashes"] = f"select domain, {_FNV} from (select domain, {_BYTES.format('domain')} from (select distinct domain from domains))"
_POS = "cast(((h1 + i * (f1 + case when f1 % 2 = 0 then 1 else 0 end)) % 18446744073709551616) % bit_count as bigint)"
WITH["each_bits"] = f"select distinct list_id, {_POS} as pos from each_list join rule_hashes using (domain) join each_size using (list_id), unnest(range(0, 10)) as t(i)"
WITH["probed"] = f"""select list_id, suffix, count(b.pos) = 10 as hit from (select list_id, suffix, {_POS} as pos from suffix_hashes, each_size, unnest(range(0, 10)) as t(i)) p
        left join each_bits b using (list_id, pos) group by 1, 2"""
WITH["suffix_hashes"] = f"select suffix, {_FNV} from (select suffix, {_BYTES.format('suffix')} from (select distinct suffix from suffixes))"
_ORDER += ["each_list", "each_size", "rule_hashes", "each_bits", "suffix_hashes", "probed"]

ORACLE_SQL: dict[str, str] = {
    "scan_list_lines": f"select list_id, count(*) as n_lines, max(strlen(raw)) as longest, max(strlen(raw)) >= 1048576 as too_long from ({X.LANDED_LINES.format(**_TABLES)}) group by 1",
    "trim_lines": with_("trimmed") + "select * from trimmed",
    "drop_comments": with_("trimmed") + f"select * from trimmed where not {_COMMENT}",
    "scriptlet_rules": with_("rules") + "select list_id, text, first_line from rules where kind = 'scriptlet'",
    "cosmetic_rules": with_("rules") + "select list_id, text, first_line from rules where kind = 'cosmetic'",
    "domain_rules": with_("rules") + "select list_id, text, first_line from rules where kind = 'domain'",
    "domains_adblock": with_("trimmed") + f"select list_id, line_no, {_checked(_ADBLOCK)} as domain from trimmed where {_checked(_ADBLOCK)} is not null",
    "domains_hosts": with_("trimmed") + f"select list_id, line_no, {_checked(_HOSTS)} as domain from trimmed where {_checked(_HOSTS)} is not null",
    "domains_plain": with_("trimmed") + f"select list_id, line_no, {_checked(_PLAIN)} as domain from trimmed where {_checked(_PLAIN)} is not null",
    "reject_reserved": with_("trimmed") + f"select list_id, line_no, {_HOSTS} as name from trimmed where lower(trim({_HOSTS})) in ({_listed(_RESERVED)})",
    "reject_ip": with_("trimmed") + f"select list_id, line_no, {_PLAIN} as name from trimmed where regexp_matches({_PLAIN}, '^[0-9][0-9.]*$')",
    "classify_lines": with_("classified") + "select * from classified",
    "classify_noise": with_("noise") + f"""select doc_id, count(*) as n_lines, count(*) filter ({_COSMETIC} and not {_COMMENT} and not {_SCRIPTLET}) as cosmetic,
        count(*) filter (not {_COMMENT} and not {_SCRIPTLET} and {_DOMAIN} is not null) as domains from noise group by 1""",
    "reversed_labels": with_("labelled") + "select list_id, domain, array_to_string(labels, '/') as labels from labelled",
    "rules_first_seen": with_("rules") + "select * from rules",
    "rule_counts": with_("counted") + "select * from counted",
    "empty_lists": with_("counted", landed=True) + "select list_id, 'failed' as status from counted where domains + cosmetic + scriptlets = 0",
    "trie_nodes": with_("nodes") + "select list_id, array_to_string(path, '/') as path, depth, is_terminal from nodes",
    "trie_children": with_("children") + "select list_id, array_to_string(path, '/') as path, child_count, child_bytes from children",
    "trie_stats": with_("nodes") + "select list_id, count(*) as node_count, count(*) filter (is_terminal) as terminal_count from nodes group by 1",
    "trie_bfs": with_("laid_out") + "select list_id, array_to_string(path, '/') as path, depth, bfs_index from laid_out",
    "trie_offsets": with_("laid_out") + "select list_id, array_to_string(path, '/') as path, bfs_index, byte_offset from laid_out",
    "fnv1a64": with_("hashed") + "select list_id, domain, h1::varchar as h1 from hashed",
    "fnv1_64": with_("hashed") + "select list_id, domain, f1::varchar as f1 from hashed",
    "bloom_params": with_("params") + "select * from params",
    "bloom_positions": with_("positions") + "select * from positions",
    "bloom_bytes": with_("positions") + _BITS,
    "match_blocked": with_("met", "match_queries") + "select * from match_queries where qname in (select qname from met)",
    "match_clean": with_("met", "match_queries") + "select * from match_queries where qname is null or qname not in (select qname from met)",
    "match_rule": with_("met") + "select qname, min_by(case when k = 0 then '.' else array_to_string(list_reverse(labels), '.') end, k) as rule, count(*) as n_rules from met group by 1",
    "dns_verdict": with_("met", "custom", "match_queries") + """select q.*, case when action = 0 then 'allow_custom' when action = 1 then 'block_custom'
        when q.qname in (select qname from met where sec) then 'block_security' when q.qname in (select qname from met where ad) then 'block_ad' else 'forward' end as verdict
        from match_queries q left join custom using (qname)""",
    "catalog_all": with_("catalog") + "select * from catalog order by name, id",
    "catalog_by_url": with_("catalog") + "select * from catalog where url = (select min(url) from catalog)",
    "catalog_dup_urls": with_("catalog", "batch") + "select url, count(*) as n from (select url from catalog union all select url from batch) group by 1 having count(*) > 1",
    "catalog_search": with_("catalog") + "select * from catalog where name ilike '%st_1%' or url ilike '%st_1%'",
    "catalog_sorted": with_("catalog") + "select id, name, rule_count, row_number() over (order by rule_count desc, id) as place from catalog order by rule_count desc, id limit 100",
    "catalog_page": with_("catalog") + "select * from catalog where name ilike '%list%' or url ilike '%list%' order by file_size, id limit 10 offset 10",
    "catalog_deep_page": with_("catalog") + "select * from catalog order by rule_count desc, id limit 15 offset 30",
    "catalog_meta": with_("catalog") + "select 2 as current_page, 10 as \"limit\", count(*) as total_records, cast(ceil(count(*) / 10.0) as int) as total_pages from catalog where name ilike '%list%' or url ilike '%list%'",
    "catalog_upsert": with_("catalog", "batch") + f"""select c.id, coalesce(b.name, c.name) as name, c.url, coalesce(b.r2_download_link, c.r2_download_link) as r2_download_link,
        coalesce(b.rule_count, c.rule_count) as rule_count, coalesce(b.file_size, c.file_size) as file_size, case when b.url is null then c.last_updated else timestamp '{X.NOW}' end as last_updated, c.created_at
        from catalog c left join batch b using (url) union all
        select (select max(id) from catalog) + row_number() over (order by url), name, url, r2_download_link, rule_count, file_size, timestamp '{X.NOW}', timestamp '{X.NOW}'
        from batch where url not in (select url from catalog)""",
    "catalog_delete": with_("catalog") + "select id, name, url from catalog where id % 7 <> 0",
    "build_todo": with_("catalog", "batch") + "select name, url from batch where url not in (select url from catalog)",
    "build_cached": with_("catalog", "batch") + "select id, name, url from catalog where url in (select url from batch)",
    "run_summary": with_("verdict") + "select page_id % 5 as run_id, count(*) filter (is_list or page_id % 3 = 0) as succeeded, count(*) filter (not is_list and page_id % 3 <> 0) as failed from verdict group by 1",
    "derive_name": with_("named") + """select page_id, url, case when malformed then 'filter' else regexp_replace(translate(replace(array_to_string(list_concat(case when owner = '' then [] else [owner] end,
        list_slice(parts, greatest(len(parts) - 2, 1), len(parts))), '_'), '@', ''), '.- ', '___') || '_' || substr(sha256(url), 1, 8), '[^\\p{L}\\p{Nd}_-]', '', 'g') end as name from named""",
    "format_bytes": """select l_orderkey, l_linenumber, n, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', n::double / 1024) when n < 1073741824 then printf('%.1f MB', n::double / 1048576)
        else printf('%.1f GB', n::double / 1073741824) end as size from (select l_orderkey, l_linenumber, cast(l_orderkey * l_partkey * (l_linenumber + 1) * 37 as bigint) as n from lineitem)""",
    "download_link": with_("catalog") + "select id, 'https://lists.example.com/' || name || '.zip?v=' || cast(epoch(last_updated) as bigint) as link from catalog",
    "url_scheme_check": "select page_id, url, starts_with(url, 'http://') or starts_with(url, 'https://') as ok from pages",
    "content_type_check": with_("fetch_log") + f"select page_id, content_type, {_BAD_TYPE} as bad from fetch_log",
    "html_check": with_("seen_log") + f"select page_id, {_HTML} as is_html, strlen(body_text) = 0 as is_empty from seen_log",
    "signature_lines": with_("trimmed") + f"select list_id, count(*) filter ({_SIGNATURE}) as signature, count(*) filter ({_LOOKS}) as plain from trimmed group by 1",
    "list_verdict": with_("verdict") + "select * from verdict",
    "validate_fetch": with_("seen_log", "verdict") + f"""select page_id, f.url, case when not (starts_with(f.url, 'http://') or starts_with(f.url, 'https://')) then 'scheme' when head_ok and head_status >= 400 then 'head_status'
        when head_ok and {_BAD_TYPE} then 'content_type' when get_status >= 400 then 'get_status' when body_text = '' then 'empty' when {_HTML} then 'html' when not is_list then 'syntax' end as problem
        from seen_log f join verdict using (page_id)""",
    "artifact_css": with_("rules") + "select list_id, cast(first_line // 100000 as bigint) as part, string_agg(text || chr(10), '' order by first_line, text) as content from rules where kind = 'cosmetic' group by 1, 2",
    "artifact_scriptlets": with_("rules") + "select list_id, row_number() over (partition by list_id order by text) as nth, text from rules where kind = 'scriptlet'",
    "artifact_info": with_("counted") + "select list_id, rule_count, 'https://lists.example.com/' || list_id as url, '2024-06-01T00:00:00Z' as updated from counted",
    "artifact_trie": with_("laid_out", "nodes") + """
        select list_id, part, cast(sum(length(digits)) // 2 as bigint) as n_bytes, sha256(unhex(string_agg(digits, '' order by spot))) as sha256 from (select list_id, spot // 1048576 as part, spot, digits from (
        select list_id, byte_offset as spot, printf('%02x%08x', is_terminal::int, child_count) as digits from laid_out
        union all select list_id, 0, printf('54524945%08x%08x%08x', 2, count(*), count(*) filter (is_terminal)) from nodes group by 1
        union all select c.list_id, p.byte_offset + 5 + sum(6 + strlen(c.path[c.depth])) over (partition by c.list_id, p.path order by c.path) - 6 - strlen(c.path[c.depth]),
        printf('%04x', strlen(c.path[c.depth])) || hex(encode(c.path[c.depth])) || printf('%08x', c.byte_offset) from laid_out c join laid_out p
        on c.list_id = p.list_id and p.path = list_slice(c.path, 1, c.depth - 1) and c.depth > 0)) group by 1, 2""",
    "artifact_bloom": with_("positions", "params") + f""", bits as ({_BITS})
        select list_id, part, cast(sum(length(digits)) // 2 as bigint) as n_bytes, sha256(unhex(string_agg(digits, '' order by spot))) as sha256 from (
        select list_id, byte_idx // 1048576 as part, byte_idx as spot, printf('%02x', coalesce(byte_val, 0)) as digits from (select list_id, unnest(range(0, bit_count // 8)) as byte_idx from params) left join bits using (list_id, byte_idx)
        union all select list_id, 0, -1, printf('424c4f4d%08x%016x%08x00000000', 1, bit_count, hash_count) from params) group by 1, 2""",
    "bundle_manifest": with_(*_MANIFEST_VIEWS) + _MANIFEST.format(_BASE),
    "publish_artifacts": with_(*_MANIFEST_VIEWS) + _MANIFEST.format(_BASE),
    "unpublish": with_(*_MANIFEST_VIEWS) + f"select * from ({_MANIFEST.format(_BASE)}) where list_id <> 'list_0'",
    "bundle_size": with_(*_MANIFEST_VIEWS) + f"select list_id, cast(sum(n_bytes) as bigint) as file_size from ({_MANIFEST.format(_BASE)}) group by 1",
    "refresh_lists": with_(*_MANIFEST_VIEWS, landed=True) + f"""select list_id, case when domains + cosmetic + scriptlets > 0 then 'ok' else 'failed' end as status, rule_count, coalesce(file_size, 0) as file_size
        from counted left join (select list_id, cast(sum(n_bytes) as bigint) as file_size from ({_MANIFEST.format("file:")}) group by 1) using (list_id)""",
    "bloom_probe": with_("probed", "suffixes") + "select distinct list_id, qname from suffixes join probed using (suffix) where hit",
    "bloom_fp_rate": with_("probed", "each_list") + """select list_id, count(*) as n_clean, count(*) filter (hit) as n_false, count(*) filter (hit) / count(*) as rate
        from probed p where not exists (select 1 from each_list e where e.list_id = p.list_id and e.domain = p.suffix) group by 1""",
    "rules_incremental_add": with_("security", "ads") + "select domain from security union select domain from ads",
    "rules_diff": with_("security", "ads") + "select domain, 'removed' as change from security where domain not in (select domain from ads) union all select domain, 'added' from ads where domain not in (select domain from security)",
    "build_strategy": """select cast(g as bigint) as "group", case when bool_or(was is not null and (now is null or now <> was)) then 'rebuild' when bool_or(was is null) then 'add' else 'cache' end as strategy
        from (select page_id % 40 as g, case when page_id % 9 <> 0 then page_id end as was, case when page_id % 40 % 4 = 3 and page_id % 9 = 1 then page_id + 1
        when page_id % 40 % 4 = 2 and page_id % 9 = 2 then null when page_id % 40 % 4 = 0 and page_id % 9 = 0 then null else page_id end as now from pages)
        where was is not null or now is not null group by 1""",
}
_GROUPED = "domains as (select distinct g as list_id, domain from one_list join (select 'security' as g, unnest(['list_0', 'list_1', 'list_2', 'list_3']) as list_id union all select 'ads', unnest(['list_4', 'list_5', 'list_6']) union all select 'solo', 'list_0') using (list_id))"
_OWN = f"domains as ({WITH['domains']})"
ORACLE_SQL["incremental_offsets"] = with_("laid_out").replace(_OWN, f"one_list as ({WITH['domains']}), {_GROUPED}") + "select list_id, array_to_string(path, '/') as path, is_terminal, bfs_index, byte_offset from laid_out"
ORACLE_SQL["incremental_bloom"] = with_("positions").replace(_OWN, f"one_list as ({WITH['domains']}), {_GROUPED}") + _BITS
ORACLE_SQL["stream_verdict"] = ORACLE_SQL["dns_verdict"]
ORACLE_SQL["catalog_write"] = ORACLE_SQL["catalog_upsert"]
