"""SQL (DuckDB) of the queries in ``catalog``."""

from __future__ import annotations

from tidewake.functions.keys import WHITE
from tidewake.functions.text import CONTEXT_TERMS, LEGAL_FORMS, NAME_ENDS
from tidewake.operators import mentions as m
from tidewake.plans.catalog import MIN_AUTHORS, NAME_FORMS, TITLES
from tidewake.plans.problem_sql import day, key, sym
from tidewake.schemas import COMMENT, COMMENT_TAGGED
from tidewake.sources.bulk import REASONS

_WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE) + "]"


def gone(c: str) -> str:
    return f"coalesce(regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g') in ('[deleted]', '[removed]'), false)"


def words(ws: list[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in ws)


# --- star schema
_STAR = f"""
panel as (
  select p_brand as symbol, cast(l_shipdate as date) as day, count(distinct o_custkey) as authors
  from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey group by all),
bars as (
  select p_brand as symbol, cast(l_shipdate as date) as day, sum(l_extendedprice) / sum(l_quantity) as adj_close from lineitem join part on p_partkey = l_partkey group by all),
market as (select cast(l_shipdate as date) as day, sum(l_extendedprice) / sum(l_quantity) as adj_close from lineitem group by all),
framed as (
  select *, count(*) over w as n, cast(sum(authors) over w as bigint) as s1, cast(sum(authors * authors) over w as bigint) as s2
  from panel window w as (partition by symbol order by day rows between 30 preceding and 1 preceding)),
scores as (
  select symbol, day, authors, case when n * s2 = s1 * s1 then case when n * authors <= s1 then 0 else cast('inf' as double) end
    else cast(n * authors - s1 as double) / sqrt(cast(n * s2 - s1 * s1 as double)) end as zscore from framed where n >= 10),
events as (select * from scores where zscore >= 2 and authors >= {MIN_AUTHORS})
"""


def _paths(b: str, mk: str, first: str, reach: int) -> str:
    """CTEs paths(symbol, day, off, ret) of events(symbol, day)."""
    return f"""
own as (select symbol, day, row_number() over w - 1 as i, case when lag(adj_close) over w > 0 then adj_close / lag(adj_close) over w - 1 end as ret from {b} window w as (partition by symbol order by day)),
idx as (select day, row_number() over (order by day) - 1 as i, case when lag(adj_close) over (order by day) > 0 then adj_close / lag(adj_close) over (order by day) - 1 end as ret from {mk}),
kept as (select distinct e.symbol, e.day from events e join {first} f on f.symbol = e.symbol and e.day >= f.first),
spread as (
  select k.symbol, k.day, off, o.i + off as oi, x.i + off as mi
  from kept k left join own o on o.symbol = k.symbol and o.day = k.day left join idx x on x.day = k.day, unnest(range(-{reach}, {reach} + 1)) as r(off)),
paths as (
  select s.symbol, s.day, cast(s.off as integer) as off, o.ret - x.ret as ret
  from spread s left join own o on o.symbol = s.symbol and o.i = s.oi left join idx x on x.i = s.mi)"""


def _stack(reach: int) -> str:
    return f"""
dates as (select day, off, avg(ret) as m from paths group by all),
across as (select off, count(m) as coverage, avg(m) as mean, stddev_samp(m) as sd from dates group by all),
stacked as (
  select cast(r.off as integer) as off, coalesce(coverage, 0) as coverage, case when coverage >= 5 then mean else 0 end as mean_return, case when coverage >= 5 then sd / sqrt(coverage) end as stderr
  from unnest(range(-{reach}, {reach} + 1)) as r(off) left join across a on a.off = r.off)"""


_FIRST = "first_listing as (select distinct symbol, date '1992-06-01' as first from bars)"
_STAR_PATHS = f"with {_STAR}, {_FIRST}, {_paths('bars', 'market', 'first_listing', 20)}"
_OUT = 'select off as "offset", round(mean_return, 8) as mean_return, round(stderr, 8) as stderr, coverage, round(sum(mean_return) over (order by off), 8) as cumulative from stacked'

# --- price bars
_BARS = "bars as (select symbol, day, arg_max({adj_close: adj_close, volume: volume, first_trade_date: first_trade_date}, {known_at: known_at, bar_id: bar_id}) as b from price_series group by all), flat as (select symbol, day, b.adj_close as adj_close, b.volume as volume, b.first_trade_date as first_trade_date from bars)"
_W = "(partition by symbol order by day)"
_SEEN = f"seen as (select {sym('symbol')} as symbol, {day('created_utc')} as day, author from mentions where author <> '[deleted]' and created_utc is not null)"
_Z = _STAR[_STAR.index("framed as") : _STAR.index("events as")].rstrip().rstrip(",")
_STATUS = f"asked as (select distinct {sym('symbol')} as symbol from mentions where {sym('symbol')} is not null), priced as (select distinct {sym('symbol')} as symbol from price_series), status as (select a.symbol, case when p.symbol is not null then 'ok' else 'no_data' end as status from asked a left join priced p on p.symbol = a.symbol)"

# --- mentions
_UNIVERSE = "universe as (select distinct symbol, lower(symbol) as name, 0 as name_rank, symbol like 'V%' as is_etf, case when symbol like 'X%' then 'context_required' when symbol like 'Y%' then 'cashtag_only' else 'safe' end as tier, symbol not like 'Y%' as name_matchable, symbol like 'X%' as name_needs_context from price_series where symbol is not null)"
_TAG = r"\$([A-Za-z]{1,5})(?:\.([A-Za-z]))?(?:$|[^\p{L}\p{N}\p{M}_])"
_TAGS = f"tags as (select doc_id, upper(case when coalesce(x[2], '') = '' then x[1] else x[1] || '.' || x[2] end) as symbol from (select doc_id, unnest(list_zip(regexp_extract_all(text, '{_TAG}', 1), regexp_extract_all(text, '{_TAG}', 2))) as x from documents))"
_EDGES = ".,!?:;()[]\"''"
_TOKENS = f"""
cut as (select doc_id, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda t: t <> '') as toks from documents where text <> ''),
toks as (select doc_id, unnest(range(1, len(toks) + 1)) as i, unnest(toks) as tok from cut),
bare as (select doc_id, i, trim(tok, '{_EDGES}') as clean, trim(lower(tok), '{_EDGES}') as low from toks),
near as (select doc_id, i from bare where low in ({words(CONTEXT_TERMS)})),
capital as (select b.doc_id, b.clean as symbol, b.i, u.tier from bare b join universe u on u.symbol = b.clean where regexp_full_match(b.clean, '[A-Z]{{1,5}}') and not u.is_etf),
ways as (
  select t.doc_id, t.symbol, 'cashtag' as method, 0.95 as confidence from tags t left join universe u on u.symbol = t.symbol where not coalesce(u.is_etf, false)
  union all select doc_id, symbol, 'bare', 0.85 from capital where tier = 'safe'
  union all select c.doc_id, c.symbol, 'context', 0.6 from capital c where tier = 'context_required' and exists (select 1 from near n where n.doc_id = c.doc_id and n.i between c.i - 6 and c.i + 6)
  union all select b.doc_id, u.symbol, 'name', 0.8 from bare b join universe u on u.name = b.low where length(u.name) >= 4 and name_matchable and not name_needs_context and not is_etf)
"""


def _fold(expr: str, steps: list[str]) -> str:
    """Nested sub-selects, one per step, each over column ``n``."""
    q = f"select p_partkey, {expr} as n from part"
    for s in steps:
        q = f"select p_partkey, {s} as n from ({q})"
    return q


def _quote(s: str) -> str:
    return s.replace("'", "''")


_NAMES = _fold(
    "lower(p_name || case p_partkey % " + str(len(NAME_FORMS)) + " " + " ".join(f"when {i} then '{_quote(f)}'" for i, f in enumerate(NAME_FORMS)) + " end)",
    [f"case when strpos(n, '{e}') > 1 then substr(n, 1, strpos(n, '{e}') - 1) else n end" for e in NAME_ENDS] + [f"case when ends_with(n, '{e}') then substr(n, 1, length(n) - {len(e)}) else n end" for e in LEGAL_FORMS],
)

# --- records
_MONTH = f"strftime({day('created_utc')}, '%Y-%m')"
_DONE = "done as (select _thread_id as unit_key, _source as track, count(*) as record_count, strftime(max(received_at) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') || '|' || _source as completed_at from comments where _thread_id is not null group by _thread_id, _source), latest as (select unit_key, arg_max(track, completed_at) as track, arg_max(record_count, completed_at) as record_count from done group by all)"
_KIND = "case " + " ".join(f"when contains(lower(title), '{w}') then '{k}'" for k, w in TITLES) + " end"
_DAILY = f"daily as (select {_MONTH} as month, count(*) as n from threads where thread_type in ('moves_tomorrow', 'daily_discussion') and created_utc is not null group by all), spine as (select strftime(unnest(generate_series((select min(month) || '-01' from daily)::date, (select max(month) || '-01' from daily)::date, interval 1 month)), '%Y-%m') as month), covered as (select s.month, coalesce(n, 0) as n, case when n is null then 'missing' when n < 10.5 then 'suspicious' else 'ok' end as status from spine s left join daily d on d.month = s.month)"

# --- bulk files
_HEAD = "substr(x, 1, 19)"
_EPOCH = f"""
trimmed as (select *, regexp_replace(created_utc, '^{_WS}+|{_WS}+$', '', 'g') as x from bulk_comments),
parsed as (
  select *, case when try_cast(x as double) is not null then
      case when abs(try_cast(x as double)) > 1e17 then null when try_cast(x as double) > 4102444800 then floor(try_cast(x as double) / 1000) else floor(try_cast(x as double)) end
    else epoch(coalesce(
      case when regexp_full_match({_HEAD}, '\\d{{4}}-\\d\\d?-\\d\\d?[ T]\\d\\d?:\\d\\d?:\\d\\d?') then try_cast(replace({_HEAD}, 'T', ' ') as timestamp) end,
      case when regexp_full_match({_HEAD}, '\\d{{4}}-\\d\\d?-\\d\\d?') then try_cast({_HEAD} as timestamp) end,
      case when regexp_matches(x, '^\\d{{4}}-\\d\\d-\\d\\d') then try_cast(regexp_replace(x, '[Zz]$', '+00:00') as timestamptz) at time zone 'UTC' end)) end as e0 from trimmed),
timed as (select *, cast(case when e0 between 1104537600 and 4102444800 then floor(e0) end as bigint) as epoch from parsed)
"""
_NORMAL = f"""
normal as (
  select row_id, coalesce(nullif(id, ''), 'feeds:' || row_id) as id, epoch as created_utc, nullif(regexp_replace(body, '^{_WS}+|{_WS}+$', '', 'g'), '') as body,
    case when abs(try_cast(score as double)) < 9e18 then cast(trunc(try_cast(score as double)) as bigint) end as score from timed),
reasoned as (select *, case when created_utc is null then 'bad_timestamp' when body is null then 'missing_body' end as r from normal),
outcome as (
  select *, coalesce(r, case when row_id > min(row_id) filter (where r is null) over (partition by id) then 'duplicate' when {gone("body")} then 'withdrawn' else 'written' end) as reason from reasoned)
"""

SQL: dict[str, str] = {
    "attention_panel": f"with {_STAR} select * from panel",
    "rolling_zscore": f"with {_STAR} select symbol, day, authors, round(zscore, 8) as zscore from scores",
    "attention_events": f"with {_STAR} select symbol, day, round(zscore, 8) as zscore, authors from events",
    "event_paths": f'{_STAR_PATHS} select symbol, day, off as "offset", round(ret, 8) as ret from paths',
    "event_stack": f"{_STAR_PATHS}, {_stack(20)} {_OUT}",
    "event_stack_size": f"{_STAR_PATHS} select count(distinct (symbol, day)) as n_events, count(distinct day) as n_dates from paths",
    "event_drift_verdict": f"{_STAR_PATHS}, {_stack(20)}, d as (select sum(mean_return) filter (where off < 0) as a, sum(mean_return) filter (where off > 0) as b from stacked) select round(a, 8) as pre_drift, round(b, 8) as post_drift, case when abs(a) < 1e-9 and abs(b) < 1e-9 then 'no movement either side' when b > abs(a) then 'chatter leads price' when a > abs(b) then 'chatter follows price' else 'mixed' end as verdict from d",
    "latest_bars": f"with {_BARS} select * from flat",
    "bar_returns": f"with {_BARS} select symbol, day, cast(row_number() over w - 1 as integer) as bar_idx, round(case when lag(adj_close) over w > 0 then adj_close / lag(adj_close) over w - 1 end, 8) as ret from flat window w as {_W}",
    "window_returns": f"with {_BARS}, r as (select symbol, day, row_number() over w - 1 as i, case when lag(adj_close) over w > 0 then adj_close / lag(adj_close) over w - 1 end as ret from flat window w as {_W}), e as (select distinct symbol, day from attention_events), s as (select e.symbol, e.day, o, r.i + o as j from e left join r on r.symbol = e.symbol and r.day = e.day, unnest(range(-5, 6)) as u(o)) select s.symbol, s.day, cast(s.o as integer) as \"offset\", round(r.ret, 8) as ret from s left join r on r.symbol = s.symbol and r.i = s.j",
    "forward_return": f"with {_BARS} select symbol, day, round(case when adj_close > 0 then lead(adj_close, 5) over {_W} / adj_close - 1 end, 8) as forward from flat",
    "dollar_volume_bucket": f"with {_BARS}, v as (select symbol, day, avg(case when adj_close <> 0 and volume <> 0 then adj_close * volume end) over (partition by symbol order by day rows between 20 preceding and current row) as dv from flat) select symbol, day, round(dv / 1000) as dollar_volume, case when dv >= 1e9 then 'mega' when dv >= 2e8 then 'large' when dv >= 5e7 then 'mid' when dv >= 5e6 then 'small' when dv is not null then 'micro' end as size_bucket from v",
    "listing_flags": f"with {_BARS} select a.symbol, a.day, coalesce(a.day >= first_trade_date, false) as listed, coalesce(a.day - first_trade_date between 0 and 365, false) as new, adj_close < 5 as penny from attention_events a left join flat f on f.symbol = a.symbol and f.day = a.day",
    "price_status": f"with {_STATUS} select * from status",
    "price_status_report": f"with {_STATUS} select count_if(status = 'ok') as fetched, count_if(status = 'no_data') as unpriceable, cast(0 as bigint) as fetch_failed, round(count_if(status = 'no_data') / count(*), 8) as unpriceable_share from status",
    "chart_bars": f"with {_BARS} select symbol, day, adj_close, cast(coalesce(trunc(volume), 0) as double) as volume from flat where adj_close is not null",
    "symbol_event_stack": f"with {_BARS}, events as (select distinct symbol, day from attention_events), market as (select day, avg(adj_close) as adj_close from flat group by all), listing as (select symbol, min(first_trade_date) as first from flat group by all), {_paths('flat', 'market', 'listing', 10)}, {_stack(10)} {_OUT}",
    "mention_zscores": f"with {_SEEN}, panel as (select symbol, day, count(distinct author) as authors from seen where symbol is not null group by all), {_Z} select symbol, day, authors, round(zscore, 8) as zscore from scores",
    "universe": f"with {_UNIVERSE} select * from universe",
    "cashtag_mentions": f"with {_TAGS} select * from tags",
    "unknown_cashtags": f"with {_TAGS} select symbol, count(*) as n from tags where symbol not in (select symbol from price_series where symbol is not null) group by all",
    "mentions_best_route": f"with {_UNIVERSE}, {_TAGS}, {_TOKENS} select doc_id, symbol, arg_max(method, confidence) as method, cast(max(confidence) as double) as confidence from ways group by all",
    "high_confidence_mentions": "select mention_id, symbol, method, confidence from mentions where confidence >= 0.8",
    "corpus_stopwords": "select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as word from documents) group by all order by n desc, word limit 400",
    "symbol_tiers": f"select distinct s as symbol, case when s in ({words(m.CASHTAG_ONLY)}) then 'cashtag_only' when s in ({words(m.CONTEXT_REQUIRED)}) then 'context_required' when lower(s) in ({words(m.TRADE_WORDS)}) then 'cashtag_only' else 'safe' end as tier from (select unnest(regexp_split_to_array(upper(title), '[^A-Z]+')) as s from posts) where s <> ''",
    "clean_names": f"select p_partkey, trim(n, ' .,') as name from ({_NAMES})",
    "project_comments": "select " + ", ".join([*COMMENT.fieldNames(), "_thread_type", "_thread_id", "_subreddit", "_source"]) + " from comments",
    "withdrawn_filter": f"select row_id, id, body from comments where not {gone('body')}",
    "retention_report": f"select count(*) as scanned, count_if({gone('body')}) as dropped, round(count_if({gone('body')}) / count(*), 8) as dropped_share from comments",
    "live_only": f"select {key('link_id')} as id, row_id from comments where {key('link_id')} in (select id from threads where id is not null)",
    "compare_sources": f"with c as (select row_id, {key('id')} as id, {gone('body')} as g, _source from comments), a as (select id, count_if(not g) as texts from c where _source = 'archive' and id is not null group by all), b as (select id, arg_max(g, row_id) as g from c where _source = 'api' and id is not null group by all) select count_if(a.id is not null and b.id is not null) as in_both, count_if(b.id is null) as archive_only, count_if(a.id is null) as api_only, cast(coalesce(sum(texts) filter (where b.g), 0) as bigint) as text_lost_to_deletion, round(count_if(a.id is not null and b.id is not null) / count(*), 8) as overlap_share from a full join b on a.id = b.id",
    "collection_stats": f"select count_if(not {gone('body')}) as comments, count_if({gone('body')}) as deleted, round(count_if({gone('body')}) / count_if(not {gone('body')}), 8) as deleted_share from comments where _source = 'api'",
    "price_status_lists": f"with {_STATUS} select status, string_agg(symbol, ',' order by symbol) as symbols from status group by all",
    "price_outcomes": f"select distinct s as symbol, case when s in (select {sym('symbol')} from price_series where {sym('symbol')} is not null) then 'bars' end as payload, case when s in (select {sym('symbol')} from price_series where {sym('symbol')} is not null) then 'ok' when contains(s, '.') then 'error' else 'no_data' end as status from (select {sym('symbol')} as s from mentions) where s is not null",
    "cache_keys": "select mention_id, replace(symbol, '/', '_') as cache_key from mentions",
    "listed_universe": f"""with own as (select upper(trim(symbol)) as symbol, trim(lower(symbol)) as name, false as etf, 0 as priority from price_series where trim(symbol) <> ''
        union all select {sym('symbol')}, lower({sym('symbol')}), {sym('symbol')} like 'V%', 1 from mentions where {sym('symbol')} is not null),
      u as (select symbol, arg_min(name, priority) as name, bool_or(etf) as is_etf, min(priority) as name_rank from own group by all),
      w as (select word, count(*) as n from (select unnest(regexp_split_to_array(lower(title), '[^a-z]+')) as word from posts) where word <> '' group by all),
      z as (select word, log10(n * 1e9 / sum(n) over ()) as zipf from w)
      select u.symbol, name, name_rank, is_etf, case when u.symbol in ({words(m.CASHTAG_ONLY)}) then 'cashtag_only' when u.symbol in ({words(m.CONTEXT_REQUIRED)}) then 'context_required'
        when lower(u.symbol) in ({words(m.TRADE_WORDS)}) or coalesce(zs.zipf, 0) >= 5.0 then 'cashtag_only' when coalesce(zs.zipf, 0) >= 3.8 then 'context_required' else 'safe' end as tier,
        name <> '' and name not in ({words(m.TRADE_WORDS)}) and coalesce(zn.zipf, 0) < 5.0 as name_matchable, coalesce(zn.zipf, 0) >= 3.8 as name_needs_context
      from u left join z zs on zs.word = lower(u.symbol) left join z zn on zn.word = u.name""",
    "mentions_in_order": f"with {_UNIVERSE}, {_TAGS}, {_TOKENS}, best as (select doc_id, symbol, arg_max(method, confidence) as method from ways group by all) select doc_id, string_agg(symbol || ':' || method, ',' order by symbol) as mentions from best group by all",
    "crawl_issues": f"select unit_key, 'truncated' as kind, cast(n as varchar) as detail from (select {key('link_id')} as unit_key, count(*) as n from comments group by all) where unit_key is not null and n >= 20",
    "last_issues": f"select unit_key, 'truncated' as kind, cast(n as varchar) as detail from (select {key('link_id')} as unit_key, count(*) as n from comments group by all) where unit_key is not null and n >= 20 order by unit_key desc limit 10",
    "archive_month_list": f"select distinct {_MONTH} as month from comments where created_utc is not null",
    "archive_purged": f"select {_MONTH} as month, id, created_utc, body from comments where created_utc is not null and not {gone('body')}",
    "api_records": f"select row_id, id, coalesce(author, '[deleted]') as author, body, created_utc, score, 't3_th' as link_id, 'th' as _thread_id, 'daily' as _thread_type, 's' as _subreddit, 'api' as _source from comments where _source = 'api' and not {gone('body')}",
    "archive_months": f"select {_MONTH} as month, count(*) as n from comments where created_utc is not null group by all",
    "archive_roundtrip": f"select {_MONTH} as month, " + ", ".join(COMMENT_TAGGED.fieldNames()) + " from comments where created_utc is not null",
    "manifest_latest": f"with {_DONE} select * from latest",
    "manifest_summary": f"with {_DONE} select track, count(*) as units, cast(sum(record_count) as bigint) as records from latest group by all",
    "pending_units": f"with {_DONE} select id as unit_key, thread_type from threads where id not in (select unit_key from done)",
    "thread_classify": f"select id, {_KIND} as kind from threads",
    "thread_types": "select thread_type, count(*) as n from threads group by all",
    "thread_dedupe": f"select id, thread_type, created_utc from (select *, row_number() over (partition by {day('created_utc')}, thread_type order by coalesce(stickied, false) desc, coalesce(distinguished <> '', false) desc, coalesce(score, 0) desc, id) as n from threads where created_utc is not null) where n = 1",
    "thread_merge": "select id, case when stickied then -1 else score end as score from threads",
    "threads_from_posts": f"select id, title, created_utc, {_KIND} as thread_type, subreddit, author from (select id, title, created_utc, subreddit, author from posts union all select id, title, created_utc, subreddit, author from threads) where {_KIND} is not null",
    "thread_coverage": f"with {_DAILY} select * from covered",
    "thread_coverage_report": f"with {_DAILY}, h as (select list(n order by n) as h from covered where n > 0) select count_if(n > 0) as months, (select h[len(h) // 2 + 1] from h) as median_per_month, coalesce(string_agg(month, ',' order by month) filter (where status = 'suspicious'), '') as suspicious, coalesce(string_agg(month, ',' order by month) filter (where status = 'missing'), '') as missing, (select count(*) from threads where created_utc is not null) as total_threads from covered",
    "cap_per_group": f"select row_id, thread, created_utc from (select *, row_number() over (partition by thread order by created_utc, row_id) as n from (select row_id, {key('link_id')} as thread, created_utc from comments) where thread is not null and created_utc is not null) where n <= 20",
    "truncated_threads": f"select * from (select {key('link_id')} as thread, count(*) as n from comments group by all) where thread is not null and n >= 20",
    "thread_comments": f"select c.row_id, t.id as _thread_id, t.thread_type as _thread_type from comments c join threads t on {key('c.link_id')} = {key('t.id')} where lower(trim(c.link_id, ' \t\n\r')) not like 't1\\_%' escape '\\' and not {gone('c.body')}",
    "crawl_stats": f"with {_DONE} select count_if(record_count < 20 and track <> 'api') as units_done, count_if(record_count < 20 and track = 'api') as units_failed, count_if(record_count >= 20) as units_truncated, cast(sum(record_count) as bigint) as records from done",
    "month_windows": "select greatest(a, date '2023-01-15') as window_start, least(cast(a + interval 2 month as date), date '2024-04-10') as window_end from (select cast(unnest(generate_series(date '2023-01-01', date '2024-04-09', interval 2 month)) as date) as a)",
    "day_spine": "select cast(unnest(generate_series(date '2023-02-01', date '2024-04-30', interval 1 day)) as date) as day",
    "parse_timestamp": f"with {_EPOCH} select row_id, epoch from timed",
    "normalise_rows": f"with {_EPOCH}, {_NORMAL} select row_id, id, created_utc, body, score from outcome where r is null",
    "ingest_outcome": f"with {_EPOCH}, {_NORMAL} select row_id, reason from outcome",
    "ingest_report": f"with {_EPOCH}, {_NORMAL} select count(*) as read, " + ", ".join(f"count_if(reason = '{r}') as {r}" for r in REASONS) + ", round(count_if(reason = 'written') / count(*), 8) as kept_share from outcome",
    "stream_daily_authors": f"select {sym('symbol')} as symbol, {day('created_utc')} as day, count(distinct author) as authors, count(*) as mentions from mentions where created_utc is not null group by all",
    "dedupe_first": "select id, min(row_id) as row_id from posts where id is not null group by all",
    "paginate": "select id, created_utc, row_id from (select *, row_number() over (partition by id order by created_utc, row_id) as n from posts where id is not null and created_utc is not null) where n = 1",
    "crowded_seconds": "select created_utc // 86400 * 86400 as created_utc, count(distinct id) as n, least(count(distinct id), 4) as recovered, count(distinct id) - least(count(distinct id), 4) as lost from posts where id is not null and created_utc is not null group by 1 having count(distinct id) > 2",
}
