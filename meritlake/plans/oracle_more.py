"""DuckDB SQL for lookups, files, writes, billing, support, crawl runs, portals and shown values."""

from __future__ import annotations

import re

from meritlake.functions import vocabulary as v
from meritlake.plans.oracle import BUDGETS, ELIGIBLE, MESSAGES, OPPORTUNITIES, PROFILES, SCORED, TRACKINGS, _event_timed, _lines
from meritlake.plans.oracle_web import DOMAIN, FIRST_EACH, LINKS, PATH, SEEDS, URL, _hits, _mapped, _metros, _residency, _unescape, _visible

PICK = "list_extract([{}], cast({} as int) + 1)"


def pick(values: list[str], n: str) -> str:
    return PICK.format(", ".join("'" + x.replace("'", "''") + "'" for x in values), n)


def crawl_sql(depth: int, cap: int) -> str:
    """Tables taken_0 .. of a breadth-first crawl over c_pages (node, domain, ok), c_edges (node, nth, target) and c_seeds (node, pos), and taken, all of them."""
    out = ["level_0 as (select node, min([cast(pos as bigint)]) as place from c_seeds group by node)"]
    for k in range(depth + 1):
        seen = " union all ".join(f"select * from taken_{j}" for j in range(k))
        used = f"(select count(*) from ({seen}) s where s.outcome = 'fetched' and s.domain = r.domain)" if k else "0"
        out.append(f"""ranked_{k} as (select l.node, p.domain, l.place, coalesce(p.ok, false) as ok, coalesce(sum(coalesce(p.ok, false)::int) over (partition by p.domain order by l.place rows between unbounded preceding and 1 preceding), 0) as turn from level_{k} l left join c_pages p on p.node = l.node),
taken_{k} as (select node, domain, {k} as depth, place, case when turn + {used} >= {cap} then 'capped' when ok then 'fetched' else 'failed' end as outcome from ranked_{k} r)""")
        if k < depth:
            before = " union all ".join(f"select node from taken_{j}" for j in range(k + 1))
            out.append(f"level_{k + 1} as (select e.target as node, min(list_append(t.place, cast(e.nth as bigint))) as place from taken_{k} t join c_edges e on e.node = t.node where t.outcome = 'fetched' and e.target not in ({before}) group by e.target)")
    out.append("taken as (" + " union all ".join(f"select * from taken_{j}" for j in range(depth + 1)) + ")")
    return ",\n".join(out)


SHOWN = "select node, depth, array_to_string(place, ',') as place, outcome from taken"
PAGE_CRAWL = f"""{LINKS}, c_pages as (select {URL} as node, max_by(page_id, page_id) as page_id, {DOMAIN.format(URL)} as domain, true as ok from pages group by {URL}),
c_edges as (select p.node, j.nth, j.url as target from judged j join c_pages p on p.page_id = j.page_id where j.follow), c_seeds as (select {URL} as node, page_id as pos from pages where page_id % 3 = 0)"""
RUN = f"""{PAGE_CRAWL}, {crawl_sql(2, 15)},
texts as (select t.node as url, t.depth, t.place, {_unescape("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")} as title, {_visible("html")} as text from taken t join c_pages c on c.node = t.node join pages p on p.page_id = c.page_id where outcome = 'fetched'),
low as (select *, lower(text) as x, {PATH.format("url")} as path from texts), seen as (select *, {_metros("x")} as ms, {_residency("x")} as state from low),
scores as (select *, {_hits("x", v.CONTENT_WORDS)} + {_hits("x", v.REGION_WORDS)} * 3 + case when {_hits("x", v.LOCAL_WORDS)} > 0 then 3 else 0 end + case when {_hits("x", v.EMPLOYER_WORDS)} > 0 then 3 else 0 end + case when len(ms) > 0 then 4 else 0 end as rel from seen),
run as (select url, title, cast(rel as int) as relevance, depth, place, state, {FIRST_EACH} as metros,
  case when url in (select {URL} from pages where page_id % 6 = 0) then 'duplicate' when title <> '' then 'ingested' else 'incomplete' end as action from scores where rel >= 2 and {_hits("path", v.NEGATIVE_PATHS)} = 0)"""

# the same over pages with an award and a deadline before their text, with what the last page of each address gives
INGEST = rf"""with made as (select page_id, url, '<p>Award $' || format('{{:,}}', page_id * 25 + 500) || '</p>' || case when page_id % 9 = 4 then '' else '<p>Deadline: ' || strftime(date '1998-01-01' + cast(page_id * 7 % 365 as int), '%B %-d, %Y') || '</p>' end || html as html from pages),
{re.sub(r"\bpages\b", "made", RUN)},
cand as (select r.*, c.page_id as k, cast(date '1998-01-01' + cast(c.page_id * 7 % 365 as int) as date) as due, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/apply/' || c.page_id as apply_at, c.page_id % 7 <> 3 as alive from run r join c_pages c on c.node = r.url),
ends as (select *, k % 6 = 0 as known, case when title = '' or k % 9 = 4 then 'incomplete' when not alive then 'dead' end as why, case when k % 10 = 0 then apply_at else url end as final_url from cand),
good as (select title, final_url, coalesce(nullif(title, ''), url) as provider, cast(k * 25 + 500 as varchar) as award, due, coalesce(state, '') as states, metros from ends where not known and why is null qualify row_number() over (partition by title, final_url order by relevance, depth desc, place desc) = 1),
whole as (select 'Old' as title, node as final_url, 'Board' as provider, '1' as award, cast(date '1998-01-01' + cast(page_id % 300 as int) as date) as due, '' as states, '' as metros, page_id % 4 = 0 as was from c_pages where page_id % 6 = 0 union all select *, false from good)"""
STEP = "select 'step {n}' as what, url, case when {known} then url when why is null then final_url end as portal_url, case when {known} then 'duplicate' else coalesce(why, '{else_}') end as action, null as title, null as provider, null as award, null as deadline, null as states, null as metros, null as archived, null as next_cycle from ends"
INGESTED = f"""{INGEST} {STEP.format(n=1, known="known", else_="created")} union all {STEP.format(n=2, known="(known or url in (select final_url from good))", else_="unchanged")}
union all select 'table', null, final_url, null, title, provider, award, cast(due as varchar), states, metros, cast(was or due < date '1998-06-01' as varchar), cast(case when not was and due < date '1998-06-01' then due + interval 1 year end as date)::varchar from whole"""

NEXT = f"""{SEEDS}, batch as (select url from d_seeds where status = 'queued' or (status = 'crawled' and seen < date '1998-05-25') order by priority desc, seen asc nulls first, url limit 20)"""

BILLING = """
e as (select event_id as seq, case event_type when 'signup' then 'created' when 'purchase' then 'paid' when 'error' then 'failed' when 'click' then 'deleted' else 'other' end as kind,
    case event_id % 3 when 0 then user_id when 1 then -5 end as meta_user, case when event_id % 5 <> 0 then 'cus_' || user_id end as customer, case when event_id % 2 = 0 then 'sub_' || user_id end as subscription,
    case event_id % 3 when 0 then 'active' when 1 then 'trialing' else 'incomplete' end as state, event_id % 4 <> 1 as cycle, user_id as who from events),
users as (select c_custkey as id from customer join nation on c_nationkey = n_nationkey),
made as (select * from e where kind = 'created' and meta_user in (select id from users)),
cus as (select customer, min_by(owner, since) as owner, min(since) as since from (select 'cus_' || id as customer, id as owner, -1 as since from users where id % 4 = 0 union all select customer, meta_user, seq from made where customer is not null) group by 1),
sub as (select subscription, min_by(meta_user, seq) as owner, min(seq) as since from made where subscription is not null group by 1),
f as (select e.*, case when kind = 'created' and meta_user in (select id from users) then meta_user when cus.since < seq then cus.owner when kind = 'deleted' and sub.since < seq then sub.owner end as u,
    kind = 'other' or (kind = 'paid' and not cycle) as skipped from e left join cus using (customer) left join sub using (subscription)),
billed as (select seq, case when not skipped then u end as user_id, case when skipped then 'ignored' when u is null then 'no_profile' when kind = 'created' then 'updated' when kind = 'deleted' then 'downgraded' when kind = 'paid' then 'renewed' else 'dunning_sent' end as outcome,
    case when skipped or u is null then null when kind = 'created' then state when kind = 'deleted' then 'canceled' when kind = 'paid' then 'active' end as status from f)"""

PAIRS = SCORED.format(on="not coalesce(is_archived, false) join d_tracks t on t.user_id = u.user_id and t.opp_id = o.opp_id")
EXTRACTS = rf"""
t as (select page_id, trim(url) as url, {_unescape("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")} as title, {_visible("html")} as text from pages),
x as (select *, try_cast(replace(regexp_extract(text, '[$£€]\s*(\d[\d,]*(?:\.\d+)?)', 1), ',', '') as double) as a, date '1998-01-01' + cast(page_id % 300 as int) as deadline from t),
found as (select *, case when a > 0 then floor(a) end as award from x)"""
OPTIONS = "[" + ", ".join(f"{{'slug': '{a}', 'states': {['*', *s]!r}}}" for a, _, _, s in v.METRO_OPTIONS) + "]"
MAILS = """case when n = 0 then 'New scholarships coming soon' else 'Update: ' || n || ' new scholarships ($' || format('{:,}', total) || ' total) for your discipline!' end"""
SOON = "We''re constantly indexing new scholarships for clinical health students. Check back soon for fresh opportunities matched to your discipline."

CODES = """p as (select page_id as k, trim(url) as url from pages), c as (select url, case when url = '' then 999 when k % 11 = 5 then 999 when k % 4 = 0 then 200 when k % 4 = 2 then 404 when k % 3 = 0 then 200 when k % 3 = 1 then 500 else 999 end as code from p union all select ' ', 999)"""

ORACLE_MORE = {
    "S14_link_codes": f"with {CODES} select url, code from c",
    "C18_verified_links": f"""with {CODES}, l as (select k, url as source, case k % 5 when 0 then url when 1 then regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/gone' else url end as url from p)
select k as page_id, case when l.url in (select url from c where code < 400) or source not in (select url from c where code < 400) then l.url else source end as final_url, l.url in (select url from c where code < 400) or source in (select url from c where code < 400) as is_valid from l""",
    "S11_bounded_fetch": f"""with p as (select {URL} as url, max(page_id) as k, max_by(html, page_id) as html from pages group by 1),
a as (select url, html, case when k % 11 = 5 or k % 10 = 3 then 'unreachable' when k % 10 = 1 then 'http 404' when k % 10 = 2 then 'http 503' when k % 13 = 5 then 'empty' when k % 13 = 7 then 'undecodable' end as error from p where url is not null)
select url, case when error is null then md5(html) end as html_md5, error from a union all select url || '&more', null, 'unreachable' from a""",
    "S11_fetch_errors": f"""with {CODES}, g as (select trim(url) as url, page_id % 2 = 0 as ok from pages) select g.url, ok, case when g.url = '' then 'blank' when code = 999 then 'unreachable' when code >= 400 then 'http' when not ok then 'empty' end as error from g join c on c.url = g.url""",
    "K13_reminder_calendar": f"""with {OPPORTUNITIES}, {TRACKINGS}, items as (select t.*, title, provider, award, deadline, opp_id % 3 = 0 and opp_id % 6 <> 0 as reminded from d_tracks t join d_opps using (opp_id) where is_planned and status in ('saved', 'in_progress', 'submitted')),
e as (select *, {_event_timed()} as event, strftime(deadline - 2, '%Y%m%d') || 'T083000Z' as rung from items)
select user_id, count(*) as n_events, count(*) filter (where reminded) as n_reminders, coalesce(min_by(rung, struct_pack(d := deadline, o := opp_id)) filter (where reminded), '') as first_reminder,
  cast(length({_lines("'BEGIN:VCALENDAR'", "'PRODID:-//Meritlake//Scholarship Deadlines//EN'", "'VERSION:2.0'", "'NAME:Meritlake Scholarship Deadlines'", "'X-WR-CALNAME:Meritlake Scholarships'", "'X-WR-TIMEZONE:UTC'")}) + 2 + sum(length(event) + 2 + case when reminded then 108 + length(title) else 0 end) + length('END:VCALENDAR') as bigint) as n_chars from e group by user_id""",
    "C19_first_areas": f"with t as (select doc_id, lower(text) as x from documents) select doc_id, list_extract({_metros('x')}, 1) as metro from t",
    "X04_hub_lists": f"with {LINKS}, f as (select domain, url, min(struct_pack(p := page_id, n := nth)) as place from judged group by 1, 2) select domain, count(*) as n, md5(string_agg(url, ' ' order by place)) as urls_md5 from f group by 1",
    "S03_lookups": "select event_id, p_name as title, p_name is not null as found from events left join part on p_partkey = event_id",
    "S04_calendar_tokens": f"""with {TRACKINGS}, u as (select c_custkey as id, sha256('salt-' || c_custkey) as token from customer join nation on c_nationkey = n_nationkey), n as (select user_id, count(*) as n from d_tracks where status in ('saved', 'in_progress', 'submitted') group by 1)
select id as caller, case when id % 10 = 0 then 'nobody' else token end as feed_token, case when id % 10 = 0 then 0 else coalesce(n, 0) end as n_events from u left join n on n.user_id = id""",
    "S05_registry": """with s as (select 'Source ' || (s_suppkey % 40) as name, s_suppkey as k, 'https://s' || s_suppkey || '.example.net/' as url from supplier where s_suppkey % 9 <> 4)
select name, url, 'state' as why, case when k % 3 = 0 then 'state_board' else 'national_association' end as category, case when k % 4 = 0 then 'therapeutics_rehab' else 'any' end as primary_discipline, 'deterministic' as scraper_type from s where k % 5 = 0
union all select lower(name), max_by(url, k), 'last', null, null, null from s group by 1""",
    "S07_seed_files": "with s as (select case when s_suppkey % 7 = 0 then '  ' else 'https://seed' || s_suppkey || '.example.org/' end as url from supplier) select url, 'file' as source from s where trim(url) <> '' union all select url, 'inline' from s",
    "S08_seed_csv": f"""select p_name || {pick([" Scholarships", " Awards", " Fund", " Student Scholarships", " Scholarship Program"], "p_partkey % 5")} as title, case when p_partkey % 5 = 2 then p_name || ' Fund' else p_name end as provider, 'https://c' || p_partkey || '.example.org/' as portal_url,
  {pick(["nursing", "medicine", "therapeutics_rehab", "public_health_emergency", "pharmacy"], "p_partkey % 5")} as disciplines, {pick(["BSN", "MD", "DPT", "MPH", "Other"], "p_partkey % 5")} as credentials, case when p_partkey % 4 = 1 then 'OH' else '' end as states,
  array_to_string(list_filter([case when p_partkey % 3 = 0 then p_type end, case when p_partkey % 2 = 0 then 'spring' end], lambda x: x is not null), ',') as tags from part where p_partkey % 6 <> 0""",
    "K07_dismissals": f"""with recursive {TRACKINGS}, r as (select user_id, event_id % 300 as opp_id, event_id as seq, event_id % 3 > 0 as dismiss, event_id % 300 in (select p_partkey from part) as known, row_number() over (partition by user_id, event_id % 300 order by event_id) as n from events),
f as (select user_id, opp_id, 0 as n, max(was) as state, 0 as d, 0 as s, 0 as x from (select user_id, opp_id, is_dismissed as was from d_tracks union all select distinct user_id, opp_id, null from r) group by user_id, opp_id
  union all select f.user_id, f.opp_id, r.n, case when r.dismiss and r.known then true when not r.dismiss and coalesce(f.state, false) then false else f.state end,
    f.d + (r.dismiss and r.known)::int, f.s + (not r.dismiss and coalesce(f.state, false))::int, f.x + ((r.dismiss and not r.known) or (not r.dismiss and not coalesce(f.state, false)))::int from f join r on r.user_id = f.user_id and r.opp_id = f.opp_id and r.n = f.n + 1)
select user_id, opp_id, state as is_dismissed, cast(d as bigint) as n_dismissed, cast(s as bigint) as n_restored, cast(x as bigint) as n_not_found from f qualify row_number() over (partition by user_id, opp_id order by n desc) = 1""",
    "K01_tracking_writes": f"""with {TRACKINGS}, a as (select user_id, opp_id, status from d_tracks union all select c_custkey, c_custkey + 1000000, null from customer join nation on c_nationkey = n_nationkey),
g as (select case when opp_id % 2 = 0 then user_id else user_id + 1 end as user_id, opp_id from d_tracks where (user_id + opp_id) % 5 = 0) select * from a where not exists (select 1 from g where g.user_id = a.user_id and g.opp_id = a.opp_id)""",
    "K06_patches": f"""with {BUDGETS} select user_id, case when user_id % 4 < 2 and user_id % 3 = 0 then 1 else direct end as direct, case when user_id % 4 < 2 and user_id % 3 = 1 then null else living end as living, case when user_id % 4 < 2 and user_id % 3 = 2 then 2.5 else rate end as interest_rate from d_budgets""",
    "K04_unseen_inserts": f"with {OPPORTUNITIES} select portal_url, case when opp_id % 7 = 0 then 2 else 1 end as n from d_opps where opp_id % 3 <> 0",
    "J11_billed_events": f"with {BILLING} select * from billed",
    "B03_billed_profiles": f"""with {BILLING}, n as (select *, case when outcome = 'renewed' or (outcome = 'updated' and status in ('active', 'trialing')) then 'premium' when outcome = 'downgraded' then 'free' end as tier from billed where user_id is not null)
select user_id, coalesce(max_by(tier, seq) filter (where tier is not null), 'free') as tier, max_by(status, seq) filter (where status is not null) as status, count(*) as n_events from n group by user_id""",
    "K16_receipts": """with p as (select event_id, user_id, cast(floor(value * 100) as bigint) as cents from events where event_type = 'purchase'), u as (select c_custkey as user_id, case when c_custkey % 8 <> 0 then split_part(replace(c_name, '#', ' '), ' ', 1) end as f from customer join nation on c_nationkey = n_nationkey),
r as (select event_id, coalesce(nullif(f, ''), 'there') as first, case when cents <> 0 then printf('$%.2f', cents / 100.0) end as amount from p left join u using (user_id))
select event_id, first, amount, 'Hi ' || first || ',' || chr(10) || chr(10) || 'Thank you for your payment' || coalesce(' of ' || amount, '') || ' for Premium.' || chr(10) as body from r""",
    "K16_reengagement_mails": f"""with {PROFILES}, {OPPORTUNITIES},
recent as (select *, case kind when 'STANDARD' then ['Medicine'] when 'LARGE' then ['ANY'] else disc end as listed from d_opps where not coalesce(is_archived, false) and created_on between date '1998-05-02' and date '1998-06-01'),
m as (select u.user_id, any_value(full_name) as name, count(r.opp_id) as n, cast(coalesce(sum(award), 0) as bigint) as total from d_profiles u left join recent r on single is null or list_contains(listed, single) where opt_in and email is not null and tier = 'free' group by u.user_id),
w as (select *, n || ' new scholarships ($' || format('{{:,}}', total) || ' total) were just indexed for your discipline!' as news, '<strong>' || n || ' new scholarships</strong> (<strong>$' || format('{{:,}}', total) || ' total</strong>) were just indexed for your discipline!' as loud, split_part(name, ' ', 1) as f from m)
select user_id, n as n_new, {MAILS} as subject, md5('Hi ' || f || ',' || chr(10) || chr(10) || case when n = 0 then '{SOON}' else 'Update: ' || news || chr(10) || chr(10) || 'Log in to see your fresh matches and start applying.' end || chr(10)) as body_md5,
  md5('<html><body><p>Hi ' || f || ',</p>' || case when n = 0 then '<p>{SOON}</p>' else '<p>Update: ' || loud || '</p><p>Log in to see your fresh matches and start applying.</p>' end || '</body></html>') as html_md5 from w""",
    "T24_support_replies": f"""with u as (select conv_id, turn, lower(coalesce(text, '') || case when turn % 2 = 0 then {pick([" quota", " Kanban", " my match score?", " billing", " deadline"], "conv_id % 5")} else '' end) as x from conversations where role = 'user')
select conv_id, turn, case {" ".join(f"when {_hits('x', w)} > 0 then '{v.REPLIES[k]}'" for k, w in v.TOPICS.items())} else 'I can only assist with questions about this product. Please ask about your account, matches or deadlines.' end as reply from u""",
    "T27_support_histories": """with h as (select conv_id, count(*) filter (where role in ('user', 'assistant') and coalesce(text, '') <> '') as n, md5(coalesce(string_agg(role || ': ' || text, chr(10) order by turn) filter (where role in ('user', 'assistant') and coalesce(text, '') <> ''), '')) as history_md5 from conversations group by 1),
a as (select user_id as conv_id, count(*) as n_asked from events group by 1) select a.conv_id, n_asked, n, history_md5 from a left join h using (conv_id)""",
    "C20_support_tickets": """with c as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn) as asked from conversations), k as (select * from c where asked < 2 or (asked = 2 and role = 'user')),
m as (select conv_id, count(*) as n_turns, left(string_agg(coalesce(text, ''), ' ' order by turn) filter (where role = 'user'), 500) as said from k group by 1 having count(*) filter (where role = 'user') >= 2)
select conv_id, 'Support escalation from ' || case when c_custkey % 7 <> 0 then 'u' || c_custkey || '@example.org' else '' end as subject, md5(case when said = '' then 'No user messages captured.' else said end) as summary, n_turns, 'open' as status from m left join customer on c_custkey = conv_id""",
    "C12_page_crawl": f"with {PAGE_CRAWL}, {crawl_sql(2, 2)} {SHOWN}",
    "C12_crawl": f"""with c_pages as (select page_id as node, {DOMAIN.format("url")} as domain, page_id % 10 <> 3 as ok from pages), n as (select count(*) as n from pages),
c_edges as (select node, i - 1 as nth, ts[i] % n as target from (select node, n, [node * 2 + 1, node * 3 + 2, node * 7 + 5, node + 1, node * 11, node * 11 + 1, node * 11 + 2, node * 11 + 3, node * 11 + 4, node * 11 + 5] as ts from c_pages, n), range(1, 11) r(i)),
c_seeds as (select node, node as pos from c_pages where node % 3 = 0), {crawl_sql(3, 15)} {SHOWN}""",
    "C11_crawl_run": f"with {RUN} select url, title, relevance, depth, state, metros, action from run",
    "C11_crawl_ingest": INGESTED,
    "K14_crawl_report": f"""with {RUN} select url, '{{"url":' || to_json(url) || coalesce(',"title":' || to_json(title), '') || ',"relevance":' || relevance || coalesce(',"state":' || to_json(state), '') || ',"depth":' || depth || ',"action":' || to_json(action) || '}}' as report
from run order by relevance desc, depth, place limit 20""",
    "G10_crawl_stats": f"""with {RUN} select (select count(*) from taken where outcome = 'fetched') as pages_crawled, (select count(*) from taken where outcome = 'failed') as errors, (select count(distinct {DOMAIN.format("node")}) from taken where outcome = 'fetched') as domains,
  count(*) as candidates, count(*) filter (where action = 'ingested') as ingested, count(*) filter (where action = 'duplicate') as duplicate, count(*) filter (where action = 'incomplete') as incomplete from run""",
    "U05_page_trees": rf"""with p as (select page_id, trim(regexp_replace({_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\s+', ' ', 'g')) as title, {_visible("html")} as text,
  list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?\bhref\s*=\s*("[^"]*")', 1), lambda h: {_unescape("h[2:-2]")}) as links from pages)
select page_id, title, cast(len(links) as bigint) as n_links, md5(array_to_string(links, ' ')) as links_md5, md5(text) as text_md5 from p""",
    "B04_ticket_histories": """with e as (select event_id, user_id, cast(ts as timestamp) as time_of, event_type from events),
tickets as (select user_id, time_of, max(event_id) as ticket_id from e where event_type = 'error' group by user_id, time_of),
met as (select a.event_id as ask_id, a.user_id, t.ticket_id, t.time_of as opened from (select * from e where event_type = 'click') a asof left join tickets t on a.user_id = t.user_id and a.time_of >= t.time_of),
seen as (select conv_id, count(*) filter (where role in ('user', 'assistant') and coalesce(text, '') <> '') as n_seen from conversations group by 1)
select ask_id, user_id, ticket_id, strftime(opened, '%Y-%m-%d %H:%M:%S') as opened_at, n_seen from met left join seen on conv_id = ticket_id % 100""",
    "P07_quarantine": """with t as (select p_partkey as k, cast(floor(p_retailprice) as int) as price, date '1998-01-01' + cast(p_partkey % 365 as int) as due from part),
r as (select k as opp_id, case when k % 7 = 0 then 'to be announced' when k % 7 <> 1 then '$' || price end as award_text, case when k % 11 = 0 then 'soon' when k % 5 = 0 then '1998-02-31' when k % 13 <> 0 then cast(due as varchar) end as due_text,
  concat_ws('; ', case when k % 17 = 0 then 'no title' end, case when k % 7 = 0 then 'no sum of money' end, case when k % 11 = 0 or k % 5 = 0 then 'no date' end) as reasons from t)
select opp_id, case when reasons = '' then replace(award_text, '$', '') else award_text end as award, due_text as deadline, reasons from r""",
    "C15_queue_loop": f"""with recursive {SEEDS}, n as (select count(*) as n from pages),
own as (select page_id as k, {URL} as url, 'https://h' || (page_id % 7) || '.example.edu/grants/' || page_id as hub from pages),
alive as (select url from own union select hub from own where k % 3 <> 0),
targets as (select url, (k * 2 + 1) % n as t from own, n where k % 2 = 1 union all select hub, unnest([(k * 5 + 3) % n, (k * 7 + 1) % n]) from own, n where k % 2 = 0),
links as (select url, 'https://h' || (t % 7) || '.example.edu/grants/' || t as target from targets),
reach as (
  select url from d_seeds where status = 'queued' or (status = 'crawled' and seen < date '1998-05-25')
  union select target from reach join alive using (url) join links using (url) where target not in (select url from d_seeds)),
met as (select coalesce(s.url, r.url) as url, r.url is not null as hit, status, priority, error_count, seen from d_seeds s full outer join reach r on s.url = r.url)
select b.url, case when not hit then status when a.url is not null then 'crawled' else 'failed' end as status, cast(coalesce(priority, 0) as int) as priority,
  cast(case when not hit then error_count when a.url is not null then 0 else coalesce(error_count, 0) + 1 end as int) as error_count, cast(case when hit then date '1998-06-01' else seen end as varchar) as last_crawled_on
from met b left join alive a on a.url = b.url""",
    "C15_queue_run": f"""with {NEXT}, got as (select b.url, b.url in (select {URL} from pages) as ok from batch b), verdict as (select count(*) filter (where not ok) < count(*) as success from got), hubs as (select distinct regexp_extract(trim(url), '^([A-Za-z]+://[^/?#]+)', 1) || '/grants/' as url from pages where page_id % 5 = 0)
select s.url, case when b.url is null then status when success then 'crawled' else 'failed' end as status, cast(priority as int) as priority, cast(case when b.url is null then error_count when success then 0 else error_count + 1 end as int) as error_count, cast(case when b.url is null then seen else date '1998-06-01' end as varchar) as last_crawled_on
from d_seeds s left join batch b on b.url = s.url, verdict union all select url, 'queued', 0, 0, null from hubs where url not in (select url from d_seeds)""",
    "U08_portal_pages": f"""with p as (select page_id as k, html from pages where page_id % 5 < 4)
select k as page_id, {pick(["pharmacist.com", "aacnnursing.org", ".gov", "scholarship"], "k % 5")} as portal, case k % 5 when 0 then 'American Pharmacists Association' when 1 then 'American Association of Colleges of Nursing' when 2 then 'Board ' || k else 'Sponsor ' || (k % 9) end as provider,
  k * 1000 + 500 as award, cast(make_date(1999, 3, cast(k % 28 + 1 as int)) as varchar) as deadline, case when k % 5 = 2 then 'OH' else '' end as states, true as for_nurses, true as for_bsn, {pick(["apha,pharmacy", "aacn,nursing", "state,higher-ed", "a,b"], "k % 5")} as tags from p""",
    "C23_contract_rules": f"""with {OPPORTUNITIES}, t as (select *, opp_id as k, case when opp_id % 2 = 0 then case when month(deadline_2) * 100 + day(deadline_2) < 601 then make_date(1999, month(deadline_2), day(deadline_2)) else make_date(1998, month(deadline_2), day(deadline_2)) end else deadline end as due
  from (select *, date '1998-01-01' + cast(opp_id % 365 as int) as deadline_2 from d_opps)),
s as (select *, case when k % 10 = 3 then 'county' when k % 16 = 0 then 'city' when k % 8 = 0 then 'county' when len(metros) > 0 then 'metro' when len(states) > 0 then 'state' else 'national' end as scope from t)
select opp_id, cast(case k % 3 when 0 then k * 2 when 1 then 0 end as bigint) as award, cast(due as varchar) as deadline, scope, case scope when 'national' then 'high' when 'state' then 'medium' when 'metro' then 'medium' else 'low' end as competition,
  case k % 5 when 0 then 'academicworks' when 1 then 'kaleidoscope' when 3 then 'openwater' end as vendor, case when k % 2 = 0 then 'loan_repayment' else 'scholarship' end as funding, 'public_health_emergency|nursing' as disciplines, cast(least(12000, length(title) * 2000) as bigint) as read_chars from s""",
    "T25_outlines": f"""with {PROFILES}, u as (select *, user_id as k, '### Part {{}} (~' || (user_id % 300) || ' words)' || chr(10) || case when user_id % 3 > 0 then '**Talking Points:**' || chr(10) || array_to_string(list_transform(range(1, user_id % 3 + 1), lambda i: '- p' || i || chr(10)), '') else '' end
   || case when user_id % 2 > 0 then '**Coaching Tips:**' || chr(10) || '- t1' || chr(10) else '' end || chr(10) as part from d_profiles),
m as (select *, '## AI Essay Outline' || chr(10) || chr(10) || '**Suggested Theme:** Theme ' || k || chr(10) || chr(10) || '**Mission Alignment:** Angle' || chr(10) || chr(10) || replace(part, '{{}}', '1') || replace(part, '{{}}', '2')
   || case when k % 4 > 0 then '### Pre-Submission Checklist' || chr(10) || array_to_string(list_transform(range(1, k % 4 + 1), lambda i: '- [ ] c' || i || chr(10)), '') else '' end as md from u)
select m.user_id, md5(case when k % 2 = 0 then 'Notes ' || k || chr(10) || chr(10) || '---' || chr(10) || chr(10) || md else md end) as notes_md5,
  case when k % 5 = 0 then 'asked' else case c_mktsegment when 'AUTOMOBILE' then 'pharmacy' when 'BUILDING' then 'Medicine (MD)' when 'FURNITURE' then 'nursing' when 'HOUSEHOLD' then 'Physical Therapy' end end as discipline from m join customer on c_custkey = m.user_id""",
    "F24_input_checks": f"""with {PROFILES} select user_id, array_to_string(list_filter([case when gpa + 0.5 > 4.0 then 'gpa' end, case when length(state) > 2 then 'state' end], lambda x: x is not null), ',') as faults, user_id % 3 <> 1 as report_ok, user_id % 2 = 0 as plan_ok,
  case when user_id % 4 = 0 then 'created' else 'forbidden' end as create_outcome, case when user_id % 3 = 0 then 'ok' else 'unauthorized' end as admin_outcome, 'disabled' as without_key, case when opt_in then '1998-06-01' when user_id % 3 = 0 then '1997-01-01' end as consent from d_profiles""",
    "P02_match_records": f"""with {PROFILES}, {OPPORTUNITIES}, {TRACKINGS}, {PAIRS}, m as (select s.*, o.deadline, o.disc, string_split({MESSAGES}, '; ') as ms from scored s join (select opp_id, deadline, disc from d_opps) o using (opp_id))
select user_id, opp_id, award as award_amount, cast(deadline as varchar) as deadline, score, nullif(min_gpa, 0) as min_gpa, nullif(cast(max_sai as double), 0) as max_sai, array_to_string(states, ',') as states, array_to_string(metros, ',') as metros,
  array_to_string(disc, ',') as disciplines, '{{"gpa":' || gpa_points || ',"geo":' || geo_points || ',"sai":' || sai_points || ',"affiliation":' || affiliation_points || ',"local":' || local_points || '}}' as breakdown, array_to_string(ms[1:3], '; ') as chips from m""",
    "P08_preview_counts": f"""with {PROFILES}, {OPPORTUNITIES}, u as (select user_id, case c_mktsegment when 'AUTOMOBILE' then ['pharmacy'] when 'BUILDING' then ['medicine (md)', 'medicine'] when 'FURNITURE' then ['nursing'] when 'HOUSEHOLD' then ['physical therapy', 'therapeutics_rehab', 'nursing'] else [] end as own from d_profiles join customer on c_custkey = user_id)
select user_id, count(opp_id) as projected_count, cast(coalesce(sum(award), 0) as bigint) as projected_funding_total from u left join d_opps on not is_archived and (len(disc) = 0 or len(own) = 0 or list_has_any(disc, own)) group by user_id""",
    "C04_feed_pages": f"""with {PROFILES}, {OPPORTUNITIES}, {SCORED.format(on="not coalesce(is_archived, false)").replace("user_id, o.opp_id, award,", "user_id, o.opp_id, award, metro, mkeys,")}, m as (select *, {MESSAGES} as messages from scored where {ELIGIBLE})
select user_id, count(*) as total, case when any_value(tier) = 'premium' then count(*) else least(count(*), 3) end as visible, cast(sum(award) as bigint) as worth, max(score) as best from m
where (contains(lower(title), 'ring') or contains(lower(provider), 'ring') or contains(lower(messages), 'ring')) and (metro is null or len(metros) = 0 or list_contains(mkeys, metro)) group by user_id""",
    "G05_free_limits": f"""with {PROFILES}, {TRACKINGS}, n as (select user_id, count(*) filter (where status <> 'archived') as n from d_tracks group by 1) select user_id, coalesce(n, 0) as n_active, tier <> 'premium' and coalesce(n, 0) >= 3 as at_limit from d_profiles left join n using (user_id)""",
    "B02_spent_searches": f"""with recursive {PROFILES}, e as (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from events where event_id % 4 > 0 and user_id in (select user_id from d_profiles where tier <> 'premium')),
fold as (select user_id, n, ts as start, 1 as used from e where n = 1 union all select e.user_id, e.n, case when e.ts >= f.start + interval 7 day then e.ts else f.start end, case when e.ts >= f.start + interval 7 day then 1 when f.used < 10 then f.used + 1 else f.used end from fold f join e on e.user_id = f.user_id and e.n = f.n + 1),
s as (select * from fold qualify row_number() over (partition by user_id order by n desc) = 1), o as (select *, timestamp '2024-01-12 00:00:00' >= start + interval 7 day as over from s)
select user_id, cast(case when over then 0 else used end as bigint) as used, cast(10 - case when over then 0 else used end as bigint) as remaining, strftime(case when over then timestamp '2024-01-12 00:00:00' else start end + interval 7 day, '%Y-%m-%d %H:%M:%S') as resets_at from o""",
    "C10_batch_counters": f"""with {EXTRACTS}, now as (select title, url, case when page_id % 2 = 0 then 1 else award end as award from found where page_id % 3 = 0), batch as (select * from found where title <> '' qualify row_number() over (partition by title, url order by page_id desc) = 1),
a as (select case when n.title is null then 'created' when n.award is not distinct from b.award then 'unchanged' else 'updated' end as action from batch b left join now n on n.title = b.title and n.url = b.url)
select action, count(*) as n from a group by 1 union all select 'incomplete', count(*) from found where title = '' having count(*) > 0""",
    "T28_shown_values": f"""with {OPPORTUNITIES}, o as (select *, opp_id as k, opp_id * 3700 as s, cast(date_trunc('month', deadline) as date) as first, last_day(deadline) as last, {pick(["NY", "PA", "", "OH"], "opp_id % 4")} as st from d_opps),
g as (select *, first - cast(dayofweek(first) as int) as a, last + cast(6 - dayofweek(last) as int) as b, list_concat(list_filter({OPTIONS}, lambda m: list_contains(m.states, st)), list_filter({OPTIONS}, lambda m: not list_contains(m.states, st))) as ms from o)
select opp_id, case when s = 0 then 'soon' when s >= 86400 then printf('in %dd %dh', s // 86400, s % 86400 // 3600) else printf('in %dh %dm', s // 3600, s % 3600 // 60) end as countdown, cast(b - a + 1 as bigint) as grid_days, cast(a as varchar) as grid_from,
  cast(floor(least(k % 3, k % 4 + 1) / (k % 4 + 1.0) * 100 + 0.5) as int) as done, array_to_string(list_transform(ms[1:3], lambda m: m.slug), ',') as metros, greatest(90 - (k % 20) * 5, 50) as fallback, {pick(["nursing", "therapeutics_rehab", "diagnostic_imaging", "medicine"], "k % 4")} as major,
  'in progress' as status, {pick(["Puget Sound", "Tampa Bay", "cbsa:42660", "a place with a rather l…"], "k % 4")} as short, {pick(["Seattle-Tacoma-Bellevue", "Tampa-St. Petersburg-Clearwater", "cbsa:42660", "a place with a rather long name"], "k % 4")} as area, {pick(["42660", "", "", ""], "k % 4")} as code from g""",
    "D01_permissive_dates": """with t as (select p_partkey as k, cast(date '1999-01-01' + cast(p_partkey % 365 as int) as date) as d from part)
select k as opp_id, cast(case when k % 7 = 6 and day(d) <= 12 then make_date(1999, day(d), month(d)) else d end as varchar) as day, case when k % 2 = 0 then 'OH' end as state from t""",
    "C17_repair_urls": f"""with {OPPORTUNITIES}, o as (select *, lower(provider) as p, regexp_extract(portal_url, '^([A-Za-z]+://[^/?#]+)', 1) as root, cast(split_part(provider, '#', 2) as int) % 4 = 0 as root_ok from d_opps),
s as (select 'brand#' || (s_suppkey % 25 + 1) as name, min(s_suppkey) as k from supplier group by 1), b as (select p, arg_min(k, case when p = name then k else 1000000 + k end) as k from (select distinct p from o), s where contains(p, name) or contains(name, p) group by p),
a as (select o.*, b.k, case when coalesce(is_archived, false) then 'already_archived' when opp_id % 4 <> 0 then 'ok' when root_ok then 'root' when b.k % 2 = 0 then 'source' else 'archived' end as action from o left join b using (p))
select opp_id, action, case action when 'root' then root when 'source' then 'https://s' || k || '.example.net/' else portal_url end as new_url from a""",
    "U03_resolved_links": f"""with p as (select page_id, regexp_extract(trim(url), '^([A-Za-z]+://[^/?#]+)', 1) as root from pages)
select page_id, case page_id % 8 when 0 then root || '/a/d' when 1 then root || '/a/b/e?y=2' when 2 then root || '/f/' when 3 then root || '/a/b/c.html?x=1' when 4 then split_part(root, '/', 1) || '//h.org/g' when 5 then root || '/a/b/c.html?z' when 6 then root || '/j' else root || '/a/b/k' end as address from p""",
}

#: What a stream of batches leaves is what all events at once do.
ORACLE_MORE["B03_billing_stream"] = ORACLE_MORE["B03_billed_profiles"]
