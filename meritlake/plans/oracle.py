"""The same results in DuckDB SQL, written apart from the engine's code."""

from __future__ import annotations

PROFILES = """
d_profiles as (
  select c_custkey as user_id, c_name as full_name, case when c_custkey % 7 <> 0 then 'u' || c_custkey || '@example.org' end as email, c_custkey % 2 = 0 as opt_in,
    case c_mktsegment when 'AUTOMOBILE' then ['pharmacy'] when 'BUILDING' then ['medicine (md)', 'medicine'] when 'FURNITURE' then ['nursing']
      when 'HOUSEHOLD' then ['physical therapy', 'therapeutics_rehab', 'nursing'] else case when c_custkey % 3 = 0 then ['diagnostic_imaging', 'any'] else [] end end as studied,
    case when c_custkey % 3 = 0 then 'diagnostic_imaging' end as single,
    case c_custkey % 5 when 0 then ['PharmD'] when 1 then ['MD', 'DO'] when 2 then ['rn'] else case when c_custkey % 4 = 0 then ['RN'] else [] end end as creds,
    case c_custkey % 7 when 0 then 'undergraduate' when 1 then 'doctoral' when 2 then 'graduate' when 3 then 'high_school_senior' when 4 then 'gap year' end as level,
    case when c_custkey % 11 <> 0 then 2.0::double + (c_custkey % 21) / 10.0::double end as gpa,
    case when c_custkey % 13 <> 0 then n_name end as state,
    case c_custkey % 6 when 0 then 'chicago' when 1 then 'new_york' when 2 then 'seattle' when 3 then 'boise' end as metro,
    case when c_custkey % 7 <> 0 then cast(floor(c_acctbal) as int) end as sai,
    case c_custkey % 4 when 0 then ['apha', 'ashp'] when 1 then ['ama'] else [] end as affs,
    list_concat(case when c_custkey % 3 = 0 then ['first_gen', 'first-generation'] else [] end, case when c_custkey % 4 = 0 then ['minority', 'underrepresented'] else [] end) as identity,
    case when c_custkey % 5 = 0 then 'premium' else 'free' end as tier
  from customer join nation on c_nationkey = n_nationkey)"""

OPPORTUNITIES = """
d_opps as (
  select p_partkey as opp_id, p_name as title, p_brand as provider, 'https://www.' || lower(replace(p_brand, '#', '')) || '.example.org/awards/' || p_partkey as portal_url,
    cast(floor(p_retailprice) as int) as award, date '1998-01-01' + cast(p_partkey % 365 as int) as deadline,
    case split_part(p_type, ' ', 1) when 'ECONOMY' then ['pharmacy'] when 'STANDARD' then ['medicine'] when 'SMALL' then ['nursing'] when 'MEDIUM' then ['therapeutics_rehab', 'nursing'] else [] end as disc,
    split_part(p_type, ' ', 1) as kind,
    case p_partkey % 6 when 0 then ['PharmD', 'RN'] when 1 then ['MD'] else [] end as creds,
    case p_partkey % 5 when 0 then ['undergraduate', 'graduate'] when 1 then ['doctoral'] else [] end as levels,
    case when p_size % 3 = 0 then 0.0::double else 2.0::double + (p_size % 20) / 10.0::double end as min_gpa,
    case when p_partkey % 4 = 0 then cast((p_partkey % 10) * 1000 as int) end as max_sai,
    case p_partkey % 3 when 0 then ['FRANCE', 'germany', 'CHINA'] when 1 then ['JAPAN', 'BRAZIL'] else [] end as states,
    case p_partkey % 3 when 0 then ['FRANCE', 'GERMANY', 'CHINA'] when 1 then ['JAPAN', 'BRAZIL'] else [] end as ustates,
    case p_partkey % 7 when 0 then ['chicago', 'cbsa:42660'] when 1 then ['NYC', 'new york-newark-jersey city', 'boise'] else [] end as metros,
    case p_partkey % 7 when 0 then ['chicago', 'seattle'] when 1 then ['nyc', 'new_york', 'boise'] else [] end as mkeys,
    case p_partkey % 9 when 0 then ['ASHP'] when 1 then ['apha', 'ASHP'] else [] end as req,
    case p_partkey % 9 when 0 then ['ashp'] when 1 then ['apha', 'ashp'] else [] end as lreq,
    case when p_partkey % 2 = 0 then ['First_Gen'] when p_partkey % 5 = 0 then [] else ['minority', 'AMA'] end as tags,
    case when p_partkey % 2 = 0 then ['first_gen'] when p_partkey % 5 = 0 then [] else ['minority', 'ama'] end as ltags,
    p_partkey % 5 = 0 as low,
    case when p_partkey % 19 <> 0 then p_partkey % 17 = 0 end as is_archived,
    p_partkey % 10 = 0 as service, p_partkey % 15 = 0 as employment,
    date '1998-01-01' + cast(p_partkey % 151 as int) as created_on
  from part)"""

TRACKINGS = """
d_tracks as (
  select o_custkey as user_id, l_partkey as opp_id, l_returnflag = 'R' as is_dismissed,
    case o_orderstatus when 'F' then 'submitted' when 'O' then 'in_progress' else case when o_custkey % 4 = 0 then 'archived' else 'saved' end end as status,
    (o_custkey + l_partkey) % 3 = 0 as is_planned
  from lineitem join orders on l_orderkey = o_orderkey
  qualify row_number() over (partition by o_custkey, l_partkey order by o_orderkey desc, l_linenumber desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) = 1)"""

BUDGETS = """
d_budgets as (
  select c_custkey as user_id, 10000 + (c_custkey % 40) * 1000 as direct, 8000 + (c_custkey % 17) * 500 as living, (c_custkey % 9) * 2500 as income, 1 + c_custkey % 6 as years, (c_custkey % 10)::double as rate
  from customer where c_custkey % 10 <> 0)"""

GATES = """(len(disc) = 0 or len(studied) = 0 or list_has_any(disc, studied)) as discipline_ok,
    (len(o.creds) = 0 or len(u.creds) = 0 or list_has_any(o.creds, u.creds)) as credential_ok,
    (len(levels) = 0 or level is null or list_contains(levels, level)) as level_ok"""

POINTS = """case when gpa is null or gpa >= coalesce(min_gpa, 0) then 25 else 0 end as gpa_points,
    case when (case when len(metros) > 0 then metro is null or list_contains(mkeys, metro) else len(states) = 0 or state is null or list_contains(ustates, state) end) then 25 else 0 end as geo_points,
    case when max_sai is null or coalesce(sai <= max_sai, false) then 25 else 0 end as sai_points,
    case when (case when len(lreq) > 0 then list_has_all(affs, lreq) else list_has_any(list_concat(affs, identity), ltags) end) then 25 else 0 end as affiliation_points"""

SCORED = f"""
pairs as (select u.user_id, o.opp_id, award, title, provider, portal_url, tier, low, gpa, min_gpa, sai, max_sai, metros, states, req, lreq, tags, ltags, service, employment,
    {GATES},
    {POINTS}
  from d_profiles u join d_opps o on {{on}}),
scored as (select *, case when low and geo_points > 0 then 10 else 0 end as local_points,
    least(100, gpa_points + geo_points + sai_points + affiliation_points + case when low and geo_points > 0 then 10 else 0 end) as score from pairs)"""

ALL_PAIRS = SCORED.format(on="not coalesce(is_archived, false)")
ELIGIBLE = "discipline_ok and credential_ok and level_ok"

MESSAGES = """array_to_string(list_concat(
      case when score < 100 then list_filter([
        case when gpa_points = 0 then 'Requires GPA >= ' || cast(min_gpa as varchar) end,
        case when sai_points = 0 then case when sai is null then 'Requires demonstrated financial need' else 'Requires SAI <= ' || max_sai || ' (yours is ' || sai || ')' end end,
        case when geo_points = 0 then case when len(metros) > 0 then 'Restricted to the ' || array_to_string(metros, ', ') || ' area' else 'Restricted to residents of: ' || array_to_string(states, ', ') end end,
        case when affiliation_points = 0 then case when len(req) > 0 then 'Requires affiliation(s): ' || array_to_string(req, ', ') when len(tags) > 0 then 'Preferenced tags not matched: ' || array_to_string(tags, ', ') end end
      ], lambda x: x is not null) else [] end,
      list_filter([case when service then 'Includes post-graduation service commitment' end, case when employment then 'Requires employment or clinical apprenticeship' end], lambda x: x is not null)), '; ')"""

MASKS = """case when locked then case when len(w) <= 1 then left(title, 1) || ' ' || repeat('█', greatest(6, length(title) - 2))
      else w[1] || ' ' || array_to_string(list_transform(w[2:], lambda x: repeat('█', greatest(4, length(x)))), ' ') end else title end as shown_title,
    case when locked then left(provider, 1) || ' ' || repeat('█', greatest(4, length(provider) - 1)) else provider end as shown_provider"""

NOTES = "'Provider: ' || provider || '. Award: $' || format('{:,}', award) || '. Apply at ' || portal_url"
ESC = "replace(replace(replace(replace({}, chr(92), chr(92) || chr(92)), ',', chr(92) || ','), ';', chr(92) || ';'), chr(10), chr(92) || 'n')"
DAY = "strftime({}, '%Y%m%d')"
CRLF = "chr(13) || chr(10)"


def _lines(*parts: str) -> str:
    return f" || {CRLF} || ".join(parts)


def _event_day() -> str:
    return _lines(
        "'BEGIN:VEVENT'", "'UID:'", "'DTSTAMP:19980601T000000Z'", f"'DTSTART;VALUE=DATE:' || {DAY.format('deadline')}", f"'DTEND;VALUE=DATE:' || {DAY.format('deadline + 1')}",
        f"'SUMMARY:' || {ESC.format('title')}", f"'DESCRIPTION:' || {ESC.format('(' + NOTES + ')')}", "'URL:' || portal_url",
        "'BEGIN:VALARM'", "'ACTION:DISPLAY'", "'DESCRIPTION:Scholarship deadline in 7 days'", "'TRIGGER:-P7D'", "'END:VALARM'", "'END:VEVENT'",
    )


def _event_timed() -> str:
    about = "('Provider: ' || provider || chr(10) || 'Award: $' || format('{:,}', award) || chr(10) || 'Status: ' || status)"
    alarm = lambda text, when: ("'BEGIN:VALARM'", "'ACTION:DISPLAY'", "'DESCRIPTION:' || " + ESC.format(f"('{text} left: ' || title || ' deadline')"), f"'TRIGGER:{when}'", "'END:VALARM'")
    return _lines(
        "'BEGIN:VEVENT'", "'UID:' || user_id || '-' || opp_id || '@meritlake.example'", "'SUMMARY:' || " + ESC.format("(title || ' — Deadline')"), f"'DESCRIPTION:' || {ESC.format(about)}",
        f"'DTSTART:' || {DAY.format('deadline')} || 'T235900Z'", f"'DTEND:' || {DAY.format('deadline + 1')} || 'T005900Z'", "'STATUS:CONFIRMED'", *alarm("7 days", "-P7D"), *alarm("1 day", "-P1D"), "'END:VEVENT'",
    )


def _calendar(head: str, event: str, where: str) -> str:
    return f"""with {OPPORTUNITIES}, {TRACKINGS}, items as (select t.*, title, provider, portal_url, award, deadline from d_tracks t join d_opps using (opp_id) where {where})
select user_id, count(*) as n_events, md5({head} || {CRLF} || string_agg({event}, {CRLF} order by deadline, opp_id) || {CRLF} || 'END:VCALENDAR') as ics_md5 from items group by user_id"""


def _encoded(c: str) -> str:
    return f"replace(url_encode({c}), '%2F', '/')"


ORACLE = {
    "C03_match_feed": f"""with {PROFILES}, {OPPORTUNITIES}, {ALL_PAIRS}
select user_id, rank, opp_id, score, award from (select *, cast(row_number() over (partition by user_id order by score desc, award desc, opp_id) as int) as rank from scored where {ELIGIBLE}) where rank <= 10""",
    "C02_score_tracked": f"""with {PROFILES}, {OPPORTUNITIES}, {TRACKINGS}, {SCORED.format(on="not coalesce(is_archived, false) join d_tracks t on t.user_id = u.user_id and t.opp_id = o.opp_id")}
select user_id, opp_id, discipline_ok, credential_ok, level_ok, gpa_points, geo_points, sai_points, affiliation_points, local_points, score, {MESSAGES} as messages from scored""",
    "C04_tiered_feed": f"""with {PROFILES}, {OPPORTUNITIES}, {TRACKINGS}, {ALL_PAIRS},
ranked as (select *, cast(row_number() over (partition by user_id order by score desc, award desc, opp_id) as int) as rank from scored s where {ELIGIBLE}
  and not exists (select 1 from d_tracks t where t.is_dismissed and t.user_id = s.user_id and t.opp_id = s.opp_id)),
seen as (select *, tier <> 'premium' and rank > 3 as locked, list_filter(string_split(title, ' '), lambda x: x <> '') as w from ranked where rank <= 10)
select user_id, rank, opp_id, score, locked as is_locked, {MASKS}, case when locked then '' else portal_url end as portal_url from seen""",
    "G06_feed_totals": f"""with {PROFILES}, {OPPORTUNITIES}, {ALL_PAIRS}
select user_id, count(*) as n, cast(sum(award) as bigint) as total, max(score) as best, count(*) filter (where score >= 100) as perfect from scored where {ELIGIBLE} group by user_id""",
    "C05_planner": f"""with {OPPORTUNITIES}, {TRACKINGS}, {BUDGETS},
planned as (select user_id, cast(sum(award) as bigint) as planned from d_tracks join d_opps using (opp_id) where is_planned group by user_id),
base as (select c_custkey as user_id, cast(coalesce(direct, 0) as bigint) as direct, cast(coalesce(living, 0) as bigint) as living, cast(coalesce(income, 0) as bigint) as income, coalesce(years, 4) as years, coalesce(rate, 7.5) / 100.0 / 12.0 as r, coalesce(planned, 0) as planned
  from customer left join d_budgets b on b.user_id = c_custkey left join planned p on p.user_id = c_custkey),
debts as (select *, direct + living as expenses, greatest(0, direct + living - planned - income) as unfunded, cast(greatest(0, direct + living - planned - income) * years as bigint) as debt from base),
paid as (select *, case when debt > 0 and r > 0 then debt * (r * pow(1 + r, 120)) / (pow(1 + r, 120) - 1) when debt > 0 then debt / 120 else 0.0 end as payment from debts)
select user_id, direct, living, expenses, income, planned, unfunded, debt, cast(round(cast(payment as decimal(20,8)), 2) as double) as monthly_payment,
  cast(round(cast(greatest(0.0, payment * 120 - debt) as decimal(20,8)), 2) as double) as lifetime_interest, expenses * 3 as cushion_3x, expenses * 5 as cushion_5x,
  case when expenses > 0 then cast(round(cast((planned + income) / (expenses * 3) * 100 as decimal(20,8)), 1) as double) else 0.0 end as cushion_percent from paid""",
    "K11_task_csv": f"""with {OPPORTUNITIES}, {TRACKINGS}, items as (select t.*, title, provider, portal_url, award, deadline from d_tracks t join d_opps using (opp_id) where is_planned),
rows as (select user_id, deadline, opp_id, title || ',' || strftime(deadline, '%m/%d/%Y') || ',Apply at ' || portal_url || ',' ||
    case when award >= 1000 then '"' || {NOTES} || '"' else {NOTES} end || ',' || upper(left(status, 1)) || lower(substr(status, 2)) || ',"Meritlake,Scholarship"' || {CRLF} as line from items),
texts as (select user_id, count(*) as n_items, 'Task Name,Due Date,Description,Notes,Section/Column,Tags' || {CRLF} || string_agg(line, '' order by deadline, opp_id) as csv from rows group by user_id)
select user_id, n_items, md5(csv) as csv_md5, length(csv) as n_chars from texts""",
    "K12_day_calendar": _calendar(_lines("'BEGIN:VCALENDAR'", "'VERSION:2.0'", "'PRODID:-//Meritlake//Scholarship Deadline Calendar//EN'", "'CALSCALE:GREGORIAN'", "'METHOD:PUBLISH'"), _event_day(), "not is_dismissed"),
    "K13_timed_calendar": _calendar(
        _lines("'BEGIN:VCALENDAR'", "'PRODID:-//Meritlake//Scholarship Deadlines//EN'", "'VERSION:2.0'", "'NAME:Meritlake Scholarship Deadlines'", "'X-WR-CALNAME:Meritlake Scholarships'", "'X-WR-TIMEZONE:UTC'"),
        _event_timed(), "status in ('saved', 'in_progress', 'submitted')",
    ),
    "T20_calendar_links": f"""with {OPPORTUNITIES}
select opp_id, 'https://calendar.google.com/render?action=TEMPLATE&text=' || {_encoded("title")} || '&dates=' || {DAY.format("deadline")} || '/' || {DAY.format("deadline + 1")} || '&details=' || {_encoded("portal_url")} || '&add=' || {_encoded("provider")} as link from d_opps""",
    "C06_archive_expired": f"""with {OPPORTUNITIES}
select opp_id, cast(deadline as varchar) as deadline, case when coalesce(deadline < date '1998-06-01' and not is_archived, false) then true else is_archived end as is_archived,
  case when coalesce(deadline < date '1998-06-01' and not is_archived, false) then cast(cast(deadline + interval 1 year as date) as varchar) end as next_cycle from d_opps""",
    "G01_archival_summary": f"""with {OPPORTUNITIES}
select count(*) as total, count(*) filter (where not is_archived) as active, count(*) filter (where is_archived) as archived, count(*) filter (where not is_archived and deadline < date '1998-06-01') as expired_active from d_opps""",
    "C07_deadline_digest": f"""with {PROFILES}, {OPPORTUNITIES}, {TRACKINGS},
due as (select t.user_id, t.opp_id, title, award, portal_url, deadline - date '1998-06-01' as days from d_tracks t join d_opps using (opp_id)
  where not is_dismissed and status <> 'archived' and not coalesce(is_archived, false) and deadline between date '1998-06-01' and date '1998-06-15'),
entries as (select user_id, count(*) as n, string_agg('  • ' || title || ' — $' || format('{{:,}}', award) || ' (due in ' || days || case when days = 1 then ' day)' else ' days)' end || chr(10) || '    Apply: ' || portal_url || chr(10) || chr(10), '' order by days, opp_id) as lines from due group by user_id)
select u.user_id, email, n as n_entries, n || case when n = 1 then ' scholarship deadline approaching' else ' scholarship deadlines approaching' end as subject,
  md5('Hi ' || coalesce(full_name, 'there') || ',' || chr(10) || chr(10) || 'You have ' || n || case when n = 1 then ' scholarship deadline approaching' else ' scholarship deadlines approaching' end
    || ' in the next 14 days:' || chr(10) || chr(10) || lines || 'Stay on track!' || chr(10)) as body_md5
from d_profiles u join entries e using (user_id) where opt_in and email is not null""",
    "C08_reengagement_digest": f"""with {PROFILES}, {OPPORTUNITIES},
recent as (select *, case kind when 'STANDARD' then ['Medicine'] when 'LARGE' then ['ANY'] else disc end as listed from d_opps where not coalesce(is_archived, false) and created_on between date '1998-05-02' and date '1998-06-01'),
found as (select u.user_id, email, count(*) as n_new, cast(sum(award) as bigint) as total from d_profiles u join recent r on single is null or list_contains(listed, single)
  where opt_in and email is not null and tier = 'free' group by u.user_id, email)
select user_id, email, n_new, total, n_new || case when n_new = 1 then ' new scholarship' else ' new scholarships' end || ' worth $' || format('{{:,}}', total) as subject from found""",
    "B01_search_quota": """with recursive e as (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from events),
fold as (select user_id, n, ts as start, 1 as used, 1 as allowed, 0 as blocked from e where n = 1
  union all
  select e.user_id, e.n, case when e.ts >= f.start + interval 7 day then e.ts else f.start end,
    case when e.ts >= f.start + interval 7 day then 1 when f.used < 10 then f.used + 1 else f.used end,
    f.allowed + case when e.ts >= f.start + interval 7 day or f.used < 10 then 1 else 0 end,
    f.blocked + case when e.ts >= f.start + interval 7 day or f.used < 10 then 0 else 1 end
  from fold f join e on e.user_id = f.user_id and e.n = f.n + 1)
select user_id, strftime(start, '%Y-%m-%d %H:%M:%S') as cycle_start, cast(used as bigint) as used, cast(allowed as bigint) as allowed, cast(blocked as bigint) as blocked
from fold qualify row_number() over (partition by user_id order by n desc) = 1""",
}

# The same feeds, not cut at a rank.
ORACLE |= {new: ORACLE[old].replace(" where rank <= 10", "") for new, old in (("C03_whole_feed", "C03_match_feed"), ("C04_whole_tiered_feed", "C04_tiered_feed"))}
