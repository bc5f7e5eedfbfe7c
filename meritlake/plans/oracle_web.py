"""DuckDB SQL for the queries over texts, pages, seeds, events and writes."""

from __future__ import annotations

from meritlake.functions import vocabulary as v
from meritlake.functions.labels import metro_terms
from meritlake.plans.oracle import BUDGETS, MESSAGES, OPPORTUNITIES, ORACLE, PROFILES, SCORED, TRACKINGS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _hits(text: str, words: list[str]) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({text}, w)))"


def _mapped(text: str, words: dict[str, list[str]]) -> str:
    cases = ", ".join(f"case when {_hits(text, w)} > 0 then {_q(k)} end" for k, w in words.items())
    return f"array_to_string(list_sort(list_filter([{cases}], lambda x: x is not null)), ',')"


def _metros(text: str) -> str:
    words, counties = metro_terms()
    cases = ", ".join(
        f"case when contains({text}, {_q(t)}) and regexp_matches({text}, {_q('(^|[^a-z' + chr(39) + '-])' + t.replace('.', chr(92) + '.') + '($|[^a-z' + chr(39) + '-])')}) then {_q(s)} end" for t, s in [*words.items(), *counties.items()]
    )
    return f"list_filter([{cases}], lambda x: x is not null)"


FIRST_EACH = "array_to_string(list_filter(ms, lambda x, i: list_position(ms, x) = i), ',')"
NAMES = [r"residents?\s+of\s+(ohio|pennsylvania)", r"(ohio|pennsylvania)\s+residents?", r"must\s+be\s+(?:an?\s+)?(ohio|pennsylvania)\s+resident", r"(ohio|pennsylvania)\s+residency", r"must\s+reside\s+in\s+(ohio|pennsylvania)", r"living\s+in\s+(ohio|pennsylvania)"]
CODES = [r"residents?\s+of\s+\b(oh|pa)\b", r"\b(oh|pa)\b\s+residents?", r"must\s+be\s+(?:an?\s+)?\b(oh|pa)\b\s+resident", r"\b(oh|pa)\b\s+residency", r"residency\s+(?:in\s+)?\b(oh|pa)\b", r"living\s+in\s+\b(oh|pa)\b", r"reside\s+in\s+\b(oh|pa)\b"]


def _residency(t: str) -> str:
    first = lambda ps: "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, {_q(p)}, 1), '')" for p in ps) + ")"
    return f"coalesce(case {first(NAMES)} when 'ohio' then 'OH' when 'pennsylvania' then 'PA' end, upper({first(CODES)}))"


def _unescape(c: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{char}')"
    return c


def _visible(html: str) -> str:
    for tag in ("script", "style", "noscript", "nav", "footer", "header"):
        html = f"regexp_replace({html}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    bare = f"regexp_replace(regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({_unescape(bare)}, '\\s+', ' ', 'g'))"


DOMAIN = r"regexp_replace(lower(regexp_extract({}, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '')"
PATH = r"lower(regexp_extract({}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1))"
FILE = f"len(list_filter({_list(v.EXTENSIONS)}, lambda e: ends_with(path, e))) > 0"
URL = "regexp_replace(trim(url), '#.*$', '')"

SEEDS = f"""
d_seeds as (select url, case when page_id % 4 = 0 then 'crawled' when page_id % 9 = 0 then 'failed' else 'queued' end as status, page_id % 3 as priority, cast(page_id % 5 as int) as error_count,
    case when page_id % 4 = 0 then date '1998-06-01' - cast(page_id % 15 as int) end as seen
  from (select {URL} as url, min(page_id) as page_id from pages group by 1))"""

LINKS = rf"""
hrefs as (select page_id, {URL} as page, trim(h) as h, i - 1 as nth from (select page_id, url, unnest(l) as h, generate_subscripts(l, 1) as i from (select page_id, url, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) as l from pages))),
full_links as (select page_id, page, cast(nth as int) as nth, regexp_replace(case when regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') then h when starts_with(h, '//') then regexp_extract(page, '^([A-Za-z]+:)', 1) || h
    when starts_with(h, '/') then regexp_extract(page, '^([A-Za-z]+://[^/?#]+)', 1) || h when starts_with(h, '?') then regexp_replace(page, '[?#].*$', '') || h
    else case when regexp_matches(f, '^[A-Za-z]+://[^/]+$') then f || '/' else f end || h end, '#.*$', '') as url
  from (select *, regexp_replace(regexp_replace(page, '[?#].*$', ''), '(://[^/]+.*/)[^/]*$', '\1') as f from hrefs) where h <> '' and not regexp_matches(h, '^(#|mailto:|tel:|javascript:)')),
links as (select *, {DOMAIN.format("url")} as domain, {DOMAIN.format("page")} as own, {PATH.format("url")} as path from full_links where regexp_matches(url, '^https?:')),
judged as (select page_id, nth, url, domain,
    not ({FILE}) and domain not in ({_list(v.BLOCKED_DOMAINS)[1:-1]}) and {_hits("path", v.NEGATIVE_PATHS)} = 0
      and (domain = own or (ends_with(domain, '.academicworks.com') and contains(path, '/opportunities')) or {_hits("path", v.PATH_WORDS)} > 0) as follow,
    not ({FILE}) and domain not in ({_list(v.BLOCKED_DOMAINS + v.SOCIAL_DOMAINS)[1:-1]}) and {_hits("path", v.NON_HUB_PATHS)} = 0 and {_hits("path", v.HUB_PATHS)} > 0 as is_hub from links)"""

ORACLE_WEB = {
    "T05_text_labels": f"""with t as (select doc_id, lower(text) as x from documents), m as (select *, {_metros("x")} as ms from t)
select doc_id, {_mapped("x", v.DISCIPLINE_WORDS)} as disciplines, {_mapped("x", v.CREDENTIAL_WORDS)} as credentials, {FIRST_EACH} as metros, {_residency("x")} as residency from m""",
    "C13_page_scores": f"""with t as (select page_id, url, {_unescape("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")} as title, {_visible("html")} as text from pages),
m as (select *, lower(text) as x from t), n as (select *, {_metros("x")} as ms, {PATH.format("url")} as path from m),
s as (select *, cast({_hits("x", v.CONTENT_WORDS)} as int) as base, cast({_hits("x", v.REGION_WORDS)} * 3 + case when {_hits("x", v.LOCAL_WORDS)} > 0 then 3 else 0 end + case when {_hits("x", v.EMPLOYER_WORDS)} > 0 then 3 else 0 end + case when len(ms) > 0 then 4 else 0 end as int) as regional from n)
select page_id, title, {DOMAIN.format("url")} as domain, length(text) as n_chars, base, regional, {FIRST_EACH} as metros, {_residency("x")} as residency, base + regional >= 2 and {_hits("path", v.NEGATIVE_PATHS)} = 0 as candidate from s""",
    "F20_link_rules": f"with {LINKS} select * from judged",
    "O03_next_seeds": f"""with {SEEDS} select url, status, cast(priority as int) as priority from d_seeds where status = 'queued' or (status = 'crawled' and seen < date '1998-05-25') order by priority desc, seen asc nulls first, url limit 20""",
    "B05_seeds_after_crawl": f"""with {SEEDS}, done as (select {URL} as url, min(page_id % 9 <> 0) as success from pages where page_id % 3 = 0 group by 1)
select s.url, case when success then 'crawled' when success is not null then 'failed' else status end as status, cast(case when success is not null then date '1998-06-01' else seen end as varchar) as last_crawled_on,
  cast(case when success then 0 when success is not null then error_count + 1 else error_count end as int) as error_count from d_seeds s left join done d on d.url = s.url""",
    "C16_new_hubs": f"""with {SEEDS}, {LINKS}, made as (select regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || ['/grants/', '/about/', '/scholarships/', '/login/', '/awards/'][nth % 5 + 1] || page_id as url, page_id from judged)
select url, min(page_id) as parent from made where not regexp_matches(url, '/(about|login)/[0-9]+$') and url not in (select url from d_seeds) group by url""",
    "K02_upsert": f"""with {OPPORTUNITIES}, batch as (select case when opp_id % 10 = 1 then title || ' II' else title end as title, portal_url, case when opp_id % 4 = 0 then award + 1 else award end as award, min_gpa, opp_id as nth from d_opps where opp_id % 3 <> 0),
again as (select title, portal_url, award + 5 as award, min_gpa, nth + (select count(*) from part) as nth from batch where nth % 7 = 0),
new as (select * from (select * from batch union all select * from again) qualify row_number() over (partition by title, portal_url order by nth desc) = 1)
select coalesce(o.title, n.title) as title, coalesce(o.portal_url, n.portal_url) as portal_url, coalesce(n.award, o.award) as award, coalesce(n.min_gpa, o.min_gpa) as min_gpa,
  case when n.title is null then 'kept' when o.title is null then 'created' when n.award = o.award and n.min_gpa = o.min_gpa then 'unchanged' else 'updated' end as action
from d_opps o full outer join new n on n.title = o.title and n.portal_url = o.portal_url""",
    "K09_erase_users": f"""with {TRACKINGS}, {BUDGETS} select 'profiles' as name, count(*) as n, cast(sum(c_custkey) as bigint) as ids from customer where c_custkey % 9 <> 0
union all select 'trackings', count(*), cast(sum(user_id) as bigint) from d_tracks where user_id % 9 <> 0 union all select 'budgets', count(*), cast(sum(user_id) as bigint) from d_budgets where user_id % 9 <> 0""",
    "K05_fill_profiles": """select c_custkey as user_id, case when c_custkey % 6 = 0 then 3.5 when c_custkey % 11 <> 0 then 2.0::double + (c_custkey % 21) / 10.0::double end as gpa,
  cast(case when c_custkey % 10 = 0 then 1200 when c_custkey % 7 <> 0 then cast(floor(c_acctbal) as int) end as double) as sai,
  case c_custkey % 6 when 0 then 'cbsa:16980' when 1 then 'New York-Newark-Jersey City' when 2 then 'seattle' when 3 then ' Boise ' when 4 then '' end as metro from customer join nation on c_nationkey = n_nationkey""",
    "B03_subscriptions": """select user_id, coalesce(max_by(case when event_type in ('signup', 'purchase') then 'premium' else 'free' end, struct_pack(ts := ts, id := event_id)) filter (where event_type in ('signup', 'purchase', 'click')), 'free') as tier,
  max_by(case when event_type in ('signup', 'purchase') then 'active' else 'canceled' end, struct_pack(ts := ts, id := event_id)) filter (where event_type in ('signup', 'purchase', 'click')) as status,
  count(*) filter (where event_type = 'purchase') as renewals, count(*) filter (where event_type = 'error') as dunnings, count(*) filter (where event_type not in ('signup', 'purchase', 'click', 'error')) as ignored
from events group by user_id""",
    "B04_support_conversations": f"""with u as (select conv_id, turn, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn) as n from conversations where role = 'user'),
c as (select *, lower(text) as x from u where n <= 4)
select conv_id, count(*) as turn_count, count(*) >= 4 as is_escalated, count(*) filter (where {_hits("trim(x)", v.REFUSED)} > 0) as n_refused,
  max(case when n = 1 then case {" ".join(f"when {_hits('x', w)} > 0 then {_q(k)}" for k, w in v.TOPICS.items())} else 'other' end end) as first_topic, md5(left(string_agg(text, ' ' order by turn), 500)) as summary
from c group by conv_id""",
    "G08_status_lists": f"""with {TRACKINGS} select user_id, count(*) filter (where status = 'saved') as saved, count(*) filter (where status = 'in_progress') as in_progress, count(*) filter (where status = 'submitted') as submitted,
  count(*) filter (where status = 'awarded') as awarded, count(*) filter (where status = 'archived') as archived, count(*) filter (where status in ('saved', 'in_progress', 'submitted', 'awarded')) >= 3 as at_limit from d_tracks group by user_id""",
    "G09_deadlines_by_day": f"""with {OPPORTUNITIES} select cast(deadline as varchar) as deadline, count(*) as n, cast(sum(award) as bigint) as total, array_to_string(list(opp_id order by award desc, opp_id desc)[:3], ',') as best from d_opps where not is_archived group by deadline""",
    "T03_parsed_fields": """with t as (select *, date '1998-01-01' + cast(p_partkey % 365 as int) as due from part)
select p_partkey as id, cast(case p_partkey % 5 when 0 then floor(p_retailprice) when 1 then floor(p_retailprice) when 3 then floor(p_retailprice) end as double) as amount,
  case p_partkey % 5 when 2 then '1998-06-02' when 4 then null else cast(due as varchar) end as due, p_type || '/' || p_brand || '/' || p_name as parts,
  case p_partkey % 6 when 0 then 'pharmacy' when 1 then 'medicine' when 2 then 'medicine' when 3 then 'any' when 4 then 'any' else 'nursing' end as discipline from t""",
    "B01_quota_stream": ORACLE["B01_search_quota"],
    "M05_profile_strength": f"""with {PROFILES}, p as (select d.*, c_mktsegment, c_custkey % 7 as seven, c_custkey % 6 as six, c_custkey % 5 as five, c_custkey % 4 as four, c_custkey % 3 as three, c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') as a,
    c_custkey % 5 <= 2 as b, c_custkey % 7 <= 4 as c from d_profiles d join customer on c_custkey = user_id),
s as (select *, cast(floor((a::int + b::int + c::int + (gpa is not null)::int + (state is not null)::int + (six <= 3)::int + (sai is not null)::int + (three = 0 or four = 0)::int) / 8.0 * 100 + 0.5) as int) as strength from p)
select user_id, strength, case when strength >= 100 then '' else array_to_string(list_filter([case when not a and three <> 0 then 'Field of Study' end, case when not b and four <> 0 then 'Target Credential' end, case when not c then 'Clinical Phase' end,
  case when gpa is null then 'GPA' end, case when state is null then 'State of Residence' end, case when six > 3 then 'Metro Area' end, case when sai is null then 'SAI Score' end, case when three <> 0 and four <> 0 then 'Demographics' end,
  case when four > 1 then 'Affiliations' end], lambda x: x is not null), ', ') end as gaps from s""",
    "S10_unrendered_pages": """select trim(url) as url, true as ok, max_by(length(trim(html)) < 600 or ((contains(html, 'track(') or contains(html, '__NEXT_DATA__')) and not contains(lower(html), '<h1')), page_id) as unrendered from pages group by 1""",
    "O07_upcoming": f"""with {OPPORTUNITIES}, {TRACKINGS} select user_id, cast(rank as int) as rank, opp_id, cast(deadline - date '1998-06-01' as int) as days from (
  select user_id, opp_id, deadline, row_number() over (partition by user_id order by deadline, opp_id) as rank from d_tracks join d_opps using (opp_id) where not is_dismissed and deadline >= date '1998-06-01') where rank <= 10""",
    "F09_keyword_feed": f"""with {PROFILES}, {OPPORTUNITIES}, {TRACKINGS}, {SCORED.format(on="not coalesce(is_archived, false) join d_tracks t on t.user_id = u.user_id and t.opp_id = o.opp_id")},
m as (select opp_id, score, title, provider, {MESSAGES} as messages from scored)
select opp_id, count(*) as n, max(score) as best from m where contains(lower(title), 'ring') or contains(lower(provider), 'ring') or contains(lower(messages), 'ring') group by opp_id""",
    "O06_latest_turn": "select conv_id, max(turn) as turn, max_by(role, turn) as role, md5(max_by(text, turn)) as text_md5 from conversations group by conv_id",
    "C09_page_extracts": rf"""with t as (select page_id, trim(url) as url, {_unescape("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")} as title, {_visible("html")} as text from pages),
src as (select trim(url) as url, arg_min(page_id, page_id) as id from pages where page_id % 2 = 0 group by 1),
x as (select *, lower(text) as x, regexp_extract(text, '[$£€]\s*(\d[\d,]*(?:\.\d+)?)', 1) as money, regexp_extract(text, '(?i)\bdeadline:?\s+([A-Za-z]{{3,9}}\.? \d{{1,2}}, \d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}})', 1) as due from t),
m as (select *, {_metros("x")} as ms, {_mapped("x", v.DISCIPLINE_WORDS)} as dis, {_mapped("x", v.CREDENTIAL_WORDS)} as cre, try_cast(replace(money, ',', '') as double) as a from x)
select page_id, title, coalesce('Source ' || id, '') as provider, case when id is null then 'general' else 'registry' end as category, case when a > 0 then floor(a) end as award, cast(try_cast(nullif(due, '') as date) as varchar) as deadline,
  case when dis <> '' then dis when id % 4 = 0 then 'nursing' else '' end as disciplines, case when cre <> '' then cre when id is not null then 'RN' else '' end as credentials, {FIRST_EACH} as metros,
  coalesce({_residency("x")}, case when id % 6 = 0 then 'OH' end) as state, coalesce(title <> '' and a > 0 and try_cast(nullif(due, '') as date) is not null, false) as complete
from m left join src s on s.url = m.url""",
}
