"""The same linkage in DuckDB SQL, as common table expressions that the queries share."""

from __future__ import annotations

from functools import reduce

from tessera.functions import words as w
from tessera.plans.fixture import SQL

E = "e as (select *, cast(substr(entity_id, 2, 1) as bigint) * 1000000000000 + cast(regexp_extract(entity_id, '([0-9]+)$', 1) as bigint) ordinal from (" + SQL.format(replace=r"regexp_replace(trim(text), '[ \n\t\r]+', ' ', 'g')", n="") + "))"


def _case(table: dict[str, str]) -> str:
    return "case t " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " else case when t in (" + ", ".join(f"'{s}'" for s in w.STOPWORDS) + ") then '' else t end end"


def transliterated(c: str) -> str:
    return reduce(lambda s, p: f"replace({s}, '{p[0]}', '{p[1]}')", w.INDIC_TO_LATIN.items(), f"coalesce({c}, '')")


def clean(c: str) -> str:
    x = reduce(lambda s, p: f"replace({s}, '{p[0]}', '{p[1]}')", w.INDIC_TO_LATIN.items(), f"lower(coalesce({c}, ''))")
    return f"trim(regexp_replace(regexp_replace(strip_accents({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def tokens(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda t: t <> '')"


def mapped(c: str, table: dict[str, str]) -> str:
    return f"list_filter(list_transform({c}, lambda t: {_case(table)}), lambda t: t <> '')"


GENERIC = ", ".join(f"'{t}'" for t in w.GENERIC_NAME_TOKENS)
M = f"""{E},
n0 as materialized (select entity_id, ordinal, upper(trim(coalesce(country, 'US'))) country, {tokens(clean('business_name'))} rn, {tokens(clean('business_address'))} ra from e),
n1 as (select *, {mapped('rn', w.LEGAL_TERMS)} name_tokens, {mapped('ra', w.ADDRESS_ABBREVIATIONS)} addr_tokens,
       list_distinct(list_filter(ra, lambda t: regexp_matches(t, '^[0-9]+[a-z]?$'))) digits from n0),
n2 as (select *, list_filter(name_tokens, lambda t: length(t) > 1 and t not in ({GENERIC})) own from n1),
m as materialized (select entity_id, ordinal, country, array_to_string(name_tokens, ' ') norm_name, name_tokens,
      case when len(own) = 0 and len(name_tokens) > 0 then name_tokens[1:1] else own end core_tokens,
      array_to_string(addr_tokens, ' ') norm_addr, addr_tokens, digits from n2),
truth as (select 'S1-' || regexp_extract(entity_id, '([0-9]+)$', 1) s1_id, entity_id target_id from e where entity_id not like 'S1-%')"""

#: Keys of the three passes and of the four capped indices: pass, weight, cap, list of keys.
THREE = [("TOK", 3.0, None, "list_filter(core_tokens, lambda t: length(t) >= 3)"),
         ("PRE", 1.5, None, "case when length(core_tokens[1]) >= 4 then [substr(core_tokens[1], 1, 4)] else [] end"),
         ("DIG", 2.0, None, "case when len(core_tokens) > 0 then list_transform(list_filter(digits, lambda d: length(d) >= 2), lambda d: d || '_' || substr(core_tokens[1], 1, 1)) else [] end")]
FOUR = [("NAME", 5.0, None, "case when norm_name <> '' then [norm_name] else [] end"),
        ("PRE", 2.0, 50, "case when length(norm_name) >= 4 then [substr(norm_name, 1, 4)] else [] end"),
        ("TOK", 3.0, 50, "list_filter(core_tokens, lambda t: length(t) >= 3)"),
        ("DIG", 1.5, 30, "digits")]


def blocked(passes: list, name: str = "blocked") -> str:
    keys = " union all ".join(f"select entity_id, ordinal, country, '{p}' pass, {x} weight, {c or 2**31} cap, unnest({k}) key from m" for p, x, c, k in passes)
    return f"""{name}_keys as ({keys}),
{name}_b as (select * from (select *, row_number() over (partition by country, pass, key order by ordinal) place from {name}_keys where entity_id not like 'S1-%') where place <= cap),
{name} as materialized (select a.entity_id s1_id, b.entity_id target_id, any_value(a.ordinal) s1_ordinal, any_value(b.ordinal) ordinal, sum(a.weight) score
      from {name}_keys a join {name}_b b using (country, pass, key) where a.entity_id like 'S1-%' group by 1, 2)"""


def phrases(c: str) -> str:
    x = f"regexp_replace(trim(lower(regexp_replace(strip_accents({transliterated(c)}), '[^\\x00-\\x7F]', '', 'g'))), '[^\\w\\s]', ' ', 'g')"
    for k in sorted(w.PHRASE_ABBREVIATIONS, key=len, reverse=True):
        x = f"regexp_replace({x}, '\\b{k}\\b', '{w.PHRASE_ABBREVIATIONS[k]}', 'gi')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


#: The hardened records, and their keys: pass, weight, cap, list of keys.
H = f"""{E},
h0 as materialized (select entity_id, ordinal, upper(trim(coalesce(country, 'US'))) country, {phrases('business_name')} norm_name, {phrases('business_address')} norm_addr from e),
m as materialized (select *, trim(regexp_replace(norm_name, '{w.LEGAL_SUFFIX.removeprefix("(?i)")}', '', 'gi')) clean_name from h0)"""
_BARE = "replace(clean_name, ' ', '')"
WRITE = [("TOK", 3.0, 200, "list_filter(string_split(clean_name, ' '), lambda t: length(t) >= 3)"),
         ("PRE", 2.0, 200, "case when length(clean_name) >= 4 then [substr(clean_name, 1, 4)] else [] end"),
         ("GRAM", 0.5, 200, f"case when length({_BARE}) >= 3 then list_distinct(list_transform(range(1, length({_BARE}) - 1), lambda i: substr({_BARE}, i, 3))) when length({_BARE}) > 0 then [{_BARE}] else [] end"),
         ("RUN", 1.5, 200, "regexp_extract_all(norm_addr, '[0-9]{2,}')")]


def inter(a: str, b: str) -> str:
    return f"len(list_intersect(list_distinct({a}), list_distinct({b})))"


def jaccard(a: str, b: str) -> str:
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0 else {inter(a, b)} * 1.0 / len(list_distinct(list_concat({a}, {b}))) end"


def grams(c: str) -> str:
    return f"case when length({c}) >= 3 then list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))) when length({c}) > 0 then [{c}] else [] end"


def levenshtein(a: str, b: str) -> str:
    return f"""case when {a} = {b} then 1.0 when least(length({a}), length({b})) = 0 then 0.0
      when starts_with({a}, {b}) or starts_with({b}, {a}) then least(length({a}), length({b})) * 1.0 / greatest(length({a}), length({b}))
      when greatest(length({a}), length({b})) > 80 then {jaccard(grams(a), grams(b))}
      else 1.0 - levenshtein({a}, {b}) * 1.0 / greatest(length({a}), length({b})) end"""


TOP = f"""{M}, {blocked(THREE)},
rescored as (select s1_id, target_id, s1_ordinal, blocked.ordinal, score + 2.0 * {inter('a.name_tokens', 'b.name_tokens')} + 3.0 * {inter('a.core_tokens', 'b.core_tokens')}
      + 1.5 * {inter('a.addr_tokens', 'b.addr_tokens')} + 2.5 * {inter('a.digits', 'b.digits')} score
      from blocked join m a on a.entity_id = s1_id join m b on b.entity_id = target_id),
top as materialized (select * from (select *, row_number() over (partition by s1_id order by score desc, ordinal) rank from rescored) where rank <= 20)"""
#: The fixed linear score of the queries.
PROB = f"""{TOP},
feats as (select top.*, round({jaccard('a.name_tokens', 'b.name_tokens')}, 9) name_jaccard,
      round(case when a.norm_addr <> '' and b.norm_addr <> '' then {jaccard('a.addr_tokens', 'b.addr_tokens')} else 0.0 end, 9) addr_jaccard
      from top join m a on a.entity_id = s1_id join m b on b.entity_id = target_id),
prob as materialized (select *, round(1.0 / (1.0 + exp(-(-4.0 + 6.0 * name_jaccard + 3.0 * addr_jaccard))), 6) prob from feats),
best as materialized (select * from (select *, row_number() over (partition by target_id order by prob desc, s1_ordinal) n from prob) where n = 1),
s1 as (select entity_id s1_id, ordinal, country from m where entity_id like 'S1-%'),
grid as (select round(0.5 + i * 0.025, 4) threshold from range(19) r(i))"""


def scores(predicted: str, by: str = "") -> str:
    """``scores``: tp, n_true, n_pred, precision, recall, f05 for each S1 id (and threshold)."""
    ids = "(select threshold, s1_id from s1, grid)" if by else "(select s1_id from s1)"
    using = "(threshold, s1_id)" if by else "(s1_id)"
    return f"""
predicted as ({predicted}),
counts as (select {by} s1_id, count(distinct target_id) n_pred, count(distinct case when (s1_id, target_id) in (select (s1_id, target_id) from truth) then target_id end) tp from predicted group by all),
trues as (select s1_id, count(distinct target_id) n_true from truth group by 1),
base as (select {by} s1_id, coalesce(n_true, 0) n_true, coalesce(n_pred, 0) n_pred, coalesce(tp, 0) tp from {ids} left join trues using (s1_id) left join counts using {using}),
pr as (select *, case when n_true = 0 and n_pred = 0 then 1.0 when n_pred > 0 then tp * 1.0 / n_pred else 0.0 end as precision_, case when n_true = 0 and n_pred = 0 then 1.0 when n_true > 0 then tp * 1.0 / n_true else 0.0 end recall_ from base),
scores as (select *, case when 0.25 * precision_ + recall_ > 0 then 1.25 * precision_ * recall_ / (0.25 * precision_ + recall_) else 0.0 end f05 from pr)"""
