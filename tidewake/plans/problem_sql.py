"""SQL (DuckDB) of the queries in ``problems``."""

from __future__ import annotations

_KEY = "nullif(trim(regexp_replace(lower(trim({0}, ' \t\n\r')), '^t[13]_', ''), ' \t\n\r'), '')"
_KIND = "case when lower(trim({0}, ' \t\n\r')) like 't1\\_%' escape '\\' then 't1' when lower(trim({0}, ' \t\n\r')) like 't3\\_%' escape '\\' then 't3' end"
_SYM = "nullif(replace(replace(upper(trim(ltrim(trim({0}, ' \t\n\r'), '$'), ' \t\n\r')), '-', '.'), '/', '.'), '')"
_DAY = "cast(date '1970-01-01' + cast(floor({0} / 86400.0) as integer) as date)"


def key(c: str) -> str:
    return _KEY.format(c)


def sym(c: str) -> str:
    return _SYM.format(c)


def day(c: str) -> str:
    return _DAY.format(c)


_REFS = f"""
refs as (
  select row_id, 'link_id' as ref_field, {key("link_id")} as k, coalesce({_KIND.format("link_id")}, 't3') as kind, received_at, created_utc from comments
  union all
  select row_id, 'parent_id', {key("parent_id")}, coalesce({_KIND.format("parent_id")}, 'any'), received_at, created_utc from comments),
parents as (
  select k, kind, min(came) as first_at from (
    select {key("id")} as k, 't1' as kind, received_at as came from comments
    union all select {key("id")}, 't3', received_at from posts
    union all select {key("id")}, 't3', timestamptz '1900-01-01 00:00:00+00' from threads) where k is not null group by all),
gone as (select distinct {key("fullname")} as k, {_KIND.format("fullname")} as kind from removals),
found as (
  select row_id, ref_field, created_utc, case when kind = 'any' then 'any' else kind end as target, received_at, k, kind,
    (select min(first_at) from parents p where p.k = r.k and (r.kind = 'any' or p.kind = r.kind)) as first_at,
    exists (select 1 from gone g where g.k = r.k and (r.kind = 'any' or g.kind = r.kind)) as removed
  from refs r where k is not null),
orphans as (
  select row_id, ref_field, target, created_utc, case when first_at is not null then 'late' when removed then 'deleted' else 'missing' end as state
  from found where first_at is null or first_at > received_at)
"""
_KEYED = f"keyed as (select *, {key('id')} as k from comments), ranked as (select *, row_number() over (partition by k order by received_at, row_id) as n from keyed)"
_KNOWN = f"""
bars as (select bar_id, {sym("symbol")} as s, day, known_at, volume, first_trade_date from price_series where first_trade_date <= day),
asked as (select mention_id, symbol, created_utc, {sym("symbol")} as s from mentions),
known as (
  select mention_id, arg_max(bar_id, (b.day, b.known_at, b.bar_id)) as bar_id
  from asked m join bars b on m.s = b.s and b.known_at <= to_timestamp(m.created_utc) and b.day <= {day("m.created_utc")}
  group by mention_id)
"""
_SEEN = f"""
seen as (
  select 'mentions' as source, author, {day("created_utc")} as day, {sym("symbol")} as symbol, nullif(trim(subreddit), '') as subreddit from mentions where trim(author) not in ('', '[deleted]')
  union all
  select 'comments', author, {day("created_utc")}, null, nullif(trim(subreddit), '') from comments where trim(author) not in ('', '[deleted]')),
counted as (
  select source, concat_ws('+', case when grouping(day) = 0 then 'day' end, case when grouping(symbol) = 0 then 'symbol' end, case when grouping(subreddit) = 0 then 'subreddit' end) as level,
    day, symbol, subreddit, count(distinct author) as n_distinct,
    (grouping(day) = 1 or day is not null) and (grouping(symbol) = 1 or symbol is not null) and (grouping(subreddit) = 1 or subreddit is not null) as whole
  from seen group by source, grouping sets ((day), (symbol), (subreddit), (day, symbol), (day, subreddit), (symbol, subreddit), (day, symbol, subreddit))
  union all
  select distinct 'mentions', 'symbol', cast(null as date), {sym("symbol")}, cast(null as varchar), 0, {sym("symbol")} is not null from attention_events)
"""

SQL: dict[str, str] = {
    "p2_found": f"with {_REFS} select row_id, ref_field, state from orphans",
    "p2_report": f"with {_REFS} select target, ref_field, state, strftime(to_timestamp(created_utc) at time zone 'UTC', '%Y-%m') as period, count(*) as n_orphans from orphans group by all",
    "p4_distinct": f"with {_SEEN} select source, level, day, symbol, subreddit, max(n_distinct) as n_distinct, cast(0 as double) as error_bound from counted where whole group by all",
    "p6_found": f"with {_KEYED} select row_id from ranked where k is not null and n > 1",
    "p6_unique": f"with {_KEYED} select * exclude (k, n, received_at), epoch_us(received_at) as received_at from ranked where k is null or n = 1",
    "p7_found": f"with {_KNOWN} select mention_id, bar_id from known",
    "p7_attributes": f"with {_KNOWN} select a.mention_id, a.symbol, a.created_utc, k.bar_id, b.volume, b.first_trade_date from asked a left join known k using (mention_id) left join bars b on b.bar_id = k.bar_id",
}


def _csv() -> str:
    """CTEs ``csv(line_id, file_name, names, fields, reason)`` of every row after the header."""
    delims = {",": ",", ";": ";", "|": "\\|", "\t": "\\t"}

    def field(d: str) -> str:
        return f'(?:"(?:[^"]|"")*"|[^"{d}]*)'

    def by_delim(make) -> str:  # noqa: ANN001
        return "case delim " + " ".join(f"when '{d}' then {make(e)}" for d, e in delims.items()) + " end"

    well = by_delim(lambda e: f"regexp_full_match(raw, '{field(e)}(?:{e}{field(e)})*')")
    cut = by_delim(lambda e: f"regexp_extract_all(raw || delim, '({field(e)}){e}', 1)")
    best = "case greatest(" + ", ".join(f"length(head) - length(replace(head, '{d}', ''))" for d in delims) + ") " + " ".join(f"when length(head) - length(replace(head, '{d}', '')) then '{d}'" for d in delims) + " end"
    white = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}]"

    def trim(c: str) -> str:
        return f"regexp_replace({c}, '^{white}+|{white}+$', '', 'g')"

    return f"""
heads as (select file_name, arg_min(raw, line_id) as head from csv_lines where line_no = 1 group by file_name),
delimited as (select file_name, head, {best} as delim from heads),
lay as (select file_name, delim, list_transform(string_split(head, delim), lambda n: lower(trim(trim(n), '"'))) as names from delimited),
cut as (select line_id, file_name, names, raw, {well} as well, {cut} as parts from csv_lines join lay using (file_name) where line_no > 1),
clean as (select line_id, file_name, names, well, list_transform(parts, lambda f: case when f like '"%' then replace(substr(f, 2, length(f) - 2), '""', '"') else f end) as fields from cut),
seen as (select *, {trim("fields[list_position(names, 'created_utc')]")} as c, {trim("fields[list_position(names, 'body')]")} as b from clean),
csv as (
  select line_id, file_name, names, fields, case when not well then 'quoting' when len(fields) <> len(names) then 'columns'
    when not coalesce(case when regexp_full_match(c, '\\d{{1,18}}') then cast(c as bigint) between 1104537600 and 4102444800 or cast(c as bigint) between 1104537600000 and 4102444800000
      when regexp_full_match(c, '\\d{{4}}-\\d\\d-\\d\\d(?:[ T]\\d\\d:\\d\\d:\\d\\dZ?)?') then epoch(try_cast(replace(rtrim(c, 'Z'), 'T', ' ') as timestamp)) between 1104537600 and 4102444800 end, false) then 'created_utc'
    when coalesce(b, '') = '' then 'body' end as reason from seen)
"""


SQL["p5_found"] = f"with {_csv()} select line_id, reason from csv where reason is not null"
SQL["p5_valid"] = f"with {_csv()} select line_id, file_name, " + ", ".join(f"fields[list_position(names, '{f}')] as {f}" for f in ("id", "created_utc", "body", "author", "score", "subreddit")) + " from csv where reason is null"


def _instants() -> str:
    """CTEs ending in ``at(row_id, us)``: each row's text cut into a zone and a clock, the clock read by a list of forms.

    A wall time is tried with the offsets in force a day before and a day after it, in this order, which gives the
    first of two occurrences; one that neither gives back was skipped, and keeps the offset before.
    """
    from tidewake.functions.instants import ABBREVIATIONS, HIGHEST, LOWEST

    offsets = " ".join(f"when '{k}' then {v}" for k, v in ABBREVIATIONS.items())
    clock = ["%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y%m%d %H%M%S", "%Y%m%d%H%M%S", "%Y%m%d", "%d %b %Y %H:%M:%S", "%b %d %H:%M:%S %Y", "%B %d, %Y %I:%M %p", "%b %d, %Y %I:%M %p"]
    day_first, month_first = ["%d/%m/%Y %H:%M", "%d/%m/%Y %H:%M:%S", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M"], ["%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %H:%M"]

    def forms(fs: list[str]) -> str:
        return "[" + ", ".join(f"'{f}'" for f in fs) + "]"

    unit = " ".join(f"when n between {LOWEST * u} and {HIGHEST * u} then cast(floor(n * {1_000_000 // u}) as bigint)" for u in (1, 1000, 1_000_000))
    zone = "'(Z|[+-]\\d\\d(?::?\\d\\d)?|[A-Z]{3,4}|[A-Z][A-Za-z]+/[A-Za-z_]+)\\]?$'"
    return f"""
texts as (select row_id, f.zone, f.day_first, trim(created_utc, ' \t\r\n') as t from bulk_comments b left join feeds f on f.feed = b.feed),
numbers as (select *, case when regexp_full_match(t, '\\d+(\\.\\d+)?(E\\d+)?') then coalesce(try_cast(t as decimal(38, 9)), try_cast(try_cast(t as double) as decimal(38, 9))) end as n from texts),
counted as (select *, case {unit} end as counted from numbers),
bared as (
  select *, regexp_replace(regexp_replace(regexp_replace(t, '^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),? ', ''), '^(.*:\\d\\d) ([A-Z]{{3,4}}) (\\d{{4}})$', '\\1 \\3 \\2'), '(\\d)[tT](\\d.*?)z?$', '\\1 \\2' || case when t like '%z' then 'Z' else '' end) as c
  from counted where counted is null),
zoned as (select *, case when regexp_matches(c, ':\\d\\d(\\.\\d+)? ?[+-]\\d\\d(:?\\d\\d)?$') or regexp_matches(c, '(\\dZ|[ \\[](UTC|GMT|[A-Z]{{2,4}}T)\\]?| \\d{{4}} UTC|[A-Za-z]+/[A-Za-z_]+\\]?)$') and not regexp_matches(c, ' (AM|PM)$') then regexp_extract(c, {zone}, 1) else '' end as z from bared),
parts as (select *, trim(case when z = '' then c else rtrim(left(c, length(c) - length(z) - case when c like '%]' then 2 else 0 end)) end) as w from zoned),
walls as (
  select *, case when regexp_matches(w, '^\\d{{1,2}}[/.]\\d') then case when day_first then try_strptime(w, {forms(day_first)}) else try_strptime(w, {forms(month_first)}) end else try_strptime(w, {forms(clock)}) end as wall,
    case when z = '' then zone when z like '%/%' then z end as tz,
    case when z ~ '[+-].*' then (case when z like '-%' then -1 else 1 end) * (cast(substr(z, 2, 2) as integer) * 60 + case when length(z) > 3 then cast(right(z, 2) as integer) else 0 end)
      else case z {offsets} end end as mins from parts),
offs as (
  select *, epoch_us(wall) as l,
    epoch_us(timezone(tz, timezone('UTC', wall - interval 1 day))) - epoch_us(wall - interval 1 day) as o1,
    epoch_us(timezone(tz, timezone('UTC', wall + interval 1 day))) - epoch_us(wall + interval 1 day) as o2 from walls where wall is not null),
at as (
  select row_id, case when tz is null then l - cast(mins as bigint) * 60000000
    when epoch_us(timezone(tz, timezone('UTC', make_timestamp(l - o1)))) = l then l - o1
    when epoch_us(timezone(tz, timezone('UTC', make_timestamp(l - o2)))) = l then l - o2 else l - o1 end as us from offs),
every as (select row_id, counted as us from counted where counted is not null union all select row_id, us from at where us between {LOWEST * 1_000_000} and {HIGHEST * 1_000_000})
"""


SQL["p3_found"] = f"with {_instants().replace('at as (', 'instants as (').replace('from at where', 'from instants where')} select row_id, cast(us as bigint) as created_us from every"
