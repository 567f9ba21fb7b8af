"""SQL for DuckDB that gives the registered queries' rows, written from the rules themselves."""

from __future__ import annotations

from tessera.functions.text import ABBREVIATIONS, ALL_SUFFIXES, COMMON_STREET_WORDS, STREETS, SUFFIXES


def _map(d: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"


def _clean(x: str) -> str:
    x = f"lower(strip_accents(replace(coalesce({x}, ''), 'ß', 'ss')))"
    x = rf"regexp_replace({x}, '\.(com|org|net|co|in|io|biz|us|fr|edu|gov)\b', '', 'g')"
    x = f"replace(replace(regexp_replace({x}, '^[#@]+', ''), '&', ' and '), '@', ' at ')"
    x = rf"regexp_replace(translate({x}, '/-', '  '), '[^\w\s]', ' ', 'g')"
    x = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    return f"array_to_string(list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''), lambda w: coalesce({_map(ABBREVIATIONS)}[w], w)), ' ')"


def _strip(x: str) -> str:
    cases = " ".join(rf"when '{k}' then regexp_replace({x}, '\b({v})\s*$', '')" for k, v in SUFFIXES.items())
    return rf"trim(case country {cases} else regexp_replace({x}, '\b({ALL_SUFFIXES})\s*$', '') end)"


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _bare(x: str) -> str:
    return f"case when regexp_replace({x}, '^0+', '') = '' then '0' else regexp_replace({x}, '^0+', '') end"


def _postal(x: str, country: bool) -> str:
    six, five = (rf"regexp_extract(coalesce({x}, ''), '\b\d{{{n}}}\b')" for n in (6, 5))
    either = f"case when {six} <> '' then {six} else {five} end"
    return f"case when country = 'India' then {six} when country in ('US', 'France') then {five} else {either} end" if country else either


def _numbers(x: str, postal: str) -> str:
    found = rf"regexp_extract_all(lower(coalesce({x}, '')), '\b\d+[a-zA-Z]?\b')"
    both = f"list_concat({found}, list_transform({found}, lambda w: {_bare('w')}))"
    return f"list_sort(list_distinct(list_filter({both}, lambda w: {postal} = '' or (w <> {postal} and w <> {_bare(postal)}))))"


COMMON = ", ".join(f"'{w}'" for w in COMMON_STREET_WORDS)
ER = r"""
er as (
  select 'S' || (doc_id % 3 + 1) || '-' || doc_id as entity_id, doc_id as doc_ord,
    array_to_string(ws[1:4], ' ') || (case doc_id % 8 when 0 then ' Inc.' when 1 then ' Pvt. Ltd.' when 2 then ' S.A.R.L.'
      when 3 then ' Co. Ltd' when 4 then ' Intl Mfg' when 5 then ' & Sons LLC' when 6 then '.com' else '' end) as business_name,
    case when doc_id % 11 = 0 then null else
      (case when doc_id % 4 = 0 then lpad(cast(n_chars % 997 as varchar), 5, '0') || 'b' else cast(n_chars % 997 as varchar) end)
      || ' ' || coalesce(ws[5], '') || ' ' || coalesce(ws[6], '') || ' st ' ||
      (case when lang = 'de' then 100000 + (n_chars * 7919) % 900000 else 10000 + (n_chars * 7919) % 90000 end) end as business_address,
    case lang when 'en' then 'US' when 'fr' then 'France' when 'de' then 'India' end as country, md5(text) as h
  from (select *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as ws from documents)
)"""
NORMAL = f"""{ER},
n1 as (select *, coalesce(country, '__UNKNOWN__') as part_key, {_clean("business_name")} as name, {_clean("business_address")} as addr0 from er),
n2 as (select *, array_to_string(list_transform({_words("addr0")}, lambda w: coalesce({_map(STREETS)}[w], w)), ' ') as addr, {_strip("name")} as c1 from n1),
n3 as (select *, {_strip("c1")} as c2 from n2),
n4 as (select *, {_strip("c2")} as c3 from n3),
n5 as (select *, case when c3 = '' then name else c3 end as core, {_postal("business_address", False)} as raw_postal, {_postal("addr", True)} as postal from n4),
n as (
  select entity_id, doc_ord, business_name, business_address, country, h, part_key, name, addr, core, raw_postal, postal,
    list_sort(list_distinct(list_filter({_words("core")}, lambda w: length(w) >= 2 and not regexp_full_match(w, '[0-9]+')))) as tokens,
    list_sort(list_distinct({_words("core")})) as toks, list_sort(list_distinct({_words("addr")})) as addr_toks,
    list_sort(list_distinct(case when core = '' then [] when length(core) < 3 then [core] else list_transform(range(1, length(core) - 1), lambda i: substr(core, i, 3)) end)) as tri,
    {_numbers("business_address", "raw_postal")} as raw_numbers, {_numbers("addr", "postal")} as numbers,
    list_filter({_words("addr")}, lambda w: length(w) >= 4 and not regexp_full_match(w, '[0-9]+') and not list_contains([{COMMON}], w)) as streets
  from n5
),
s1 as (select * from n where entity_id like 'S1-%'),
tg as (select * from n where entity_id not like 'S1-%'),
gt as (select a.entity_id as s1_id, b.entity_id as target_id from s1 a join tg b on a.h = b.h)"""


def _keys(side: str, streets: str) -> str:
    return f"""
  select part_key, entity_id, doc_ord, 'core_name' as channel, core as key from {side} where core <> ''
  union all select part_key, entity_id, doc_ord, 'name_tokens', unnest(tokens) from {side}
  union all select part_key, entity_id, doc_ord, 'prefix', unnest(list_transform(list_filter(tokens, lambda w: length(w) >= 5), lambda w: w[1:4] || '$')) from {side}
  union all select part_key, entity_id, doc_ord, 'postal', raw_postal from {side} where raw_postal <> ''
  union all select part_key, entity_id, doc_ord, 'number', unnest(raw_numbers) from {side}
  union all select part_key, entity_id, doc_ord, 'compound_address', 'p_' || raw_postal || '_' || num from (select *, unnest(raw_numbers) as num from {side}) where raw_postal <> ''
  union all select part_key, entity_id, doc_ord, 'compound_address', 'a_' || sw || '_' || num from (select *, unnest({streets}) as sw from (select *, unnest(raw_numbers) as num from {side}))"""


#: First occurrences of the street words, in order.
FIRST_STREETS = "list_filter(streets, lambda w, i: list_position(streets, w) = i)[1:3]"
POSTINGS = f"{NORMAL},\npost as ({_keys('tg', 'streets[1:3]')}\n),\nstats as (select part_key, channel, key, count(*) as n from post group by all),\nqk as ({_keys('s1', FIRST_STREETS)}\n)"


def scored(channels: tuple[str, ...], name: str = "sc", queries: str = "qk") -> str:
    """A table of scores by pair and family."""
    inside = ", ".join(f"'{c}'" for c in channels)
    return f"""{name} as (
  select q.entity_id as s1_id, p.entity_id as target_id, p.doc_ord,
    round(sum(4.0::double) filter (p.channel = 'core_name'), 9) as core,
    round(sum((case when p.channel = 'prefix' then 0.5 else 1.0 end)::double * ln((d.docs + 1)::double / (s.n + 1))) filter (p.channel in ('name_tokens', 'prefix')), 9) as token,
    round(sum(1.0::double + ln((d.docs + 1)::double / (s.n + 1))) filter (p.channel = 'number'), 9) as number,
    round(sum(1.5::double) filter (p.channel = 'postal'), 9) as postal,
    round(sum((case when p.key like 'p\\_%' escape '\\' then 3.5 else 2.5 end)::double) filter (p.channel = 'compound_address'), 9) as address,
    round(sum(case p.channel when 'core_name' then 4.0::double when 'name_tokens' then ln((d.docs + 1)::double / (s.n + 1)) when 'prefix' then 0.5::double * ln((d.docs + 1)::double / (s.n + 1))
      when 'postal' then 1.5::double when 'number' then 1.0::double + ln((d.docs + 1)::double / (s.n + 1)) else case when p.key like 'p\\_%' escape '\\' then 3.5::double else 2.5::double end end), 9) as combined
  from {queries} q join post p using (part_key, channel, key) join stats s using (part_key, channel, key) join (select part_key, count(*) as docs from tg group by 1) d using (part_key)
  where q.channel in ({inside}) and s.n <= case q.channel when 'name_tokens' then 30000 when 'compound_address' then 1000 else 5000 end
  group by 1, 2, 3
)"""


def reserved(top_k: int, name: str = "cand", source: str = "sc") -> str:
    """The tables of a reserved selection; the last is the ranked candidates."""
    out, prev = [], source
    for i, (has, by, slots) in enumerate((("core", "core", top_k // 3), ("number", "number", top_k // 6), ("postal", "postal", top_k // 6), ("address", "combined", top_k // 3))):
        before = "false" if i == 0 else "picked"
        out.append(f"{name}_{i} as (select * exclude (was, r), was or ({has} is not null and r <= {slots}) as picked from (select *{' exclude (picked)' if i else ''}, {before} as was, row_number() over (partition by s1_id, {before}, {has} is not null order by {by} desc, doc_ord) as r from {prev}))")
        prev = f"{name}_{i}"
    out.append(f"{name}_f as (select *, row_number() over (partition by s1_id, picked order by combined desc, doc_ord) as fr, count(*) filter (picked) over (partition by s1_id) as np from {prev})")
    out.append(f"{name} as (select s1_id, target_id, doc_ord, cast(row_number() over (partition by s1_id order by combined desc, doc_ord) as int) as rank, combined from {name}_f where picked or fr <= {top_k} - np)")
    # a row already picked must not be picked again by its rank among picked rows: they keep their flag either way
    return ",\n".join(out)


F05 = "case when {g} = 0 and {p} = 0 then 1.0::double when {g} = 0 or {p} = 0 or {t} = 0 then 0.0::double else 1.25::double * {t} / (0.25::double * {g} + {p}) end"
DEFAULT = ("core_name", "name_tokens", "postal", "number", "compound_address")


def candidates(top_k: int, channels: tuple[str, ...] = DEFAULT) -> str:
    return f"{POSTINGS},\n{scored(channels)},\n{reserved(top_k)}"


JACCARD = "len(list_intersect({a}, {b}))::double / greatest(len(list_distinct(list_concat({a}, {b}))), 1)"
