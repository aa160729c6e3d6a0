"""SQL for DuckDB that gives the rows of the queries which SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER

# Fixed values of the SQL's own, written out apart from the operators': metrics and cutoffs, and the patterns of secrets.
RULES = {
    "symbols_per_word": ("n_symbols", "n_words", [3.0 - 0.1 * i for i in range(29)]),
    "repeated_word_share": ("n_repeat_words", "n_words", [1.0 - 0.025 * i for i in range(38)]),
    "duplicate_line_share": ("n_dup_lines", "n_lines", [0.95 - 0.05 * i for i in range(18)]),
    "chars_per_word": ("word_chars", "n_words", [16.0 - 0.5 * i for i in range(22)]),
}
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, CANDIDATE = "AKIA[A-Z0-9]+", "[0-9a-f]{32,}", "[A-Za-z0-9+/_=-]{20,}"

_LOWER = f"translate(%s, '{UPPER}', '{LOWER}')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) i from d),
k as (select *, {_LOWER % f"trim(line, {_SPACE})"} k from l),
r as (select k, max(doc_id) top from k where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
m as (select k.*, r.k is not null and k.doc_id < r.top gone from k left join r on k.k = r.k)
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256 from m group by doc_id"""

NEAR = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER % "coalesce(text, '')"}, '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) sh from w),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 85 * (x.n + y.n - c)),
r as (select doc_id a, doc_id b from documents union select r.a, e.b from r join e on r.b = e.a),
g as (select a, min(b) b from r group by a)
select d.doc_id, coalesce(n.n, 0) n_shingles, g.b component_id, g.b = d.doc_id kept from documents d join g on g.a = d.doc_id left join n on n.doc_id = d.doc_id"""


def _found(k: int) -> str:
    """Spans of the matches m of pattern k, from the texts p between them."""
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    start = f"({size(f'p{k}[1:i]')} + {size(f'm{k}[1:i - 1]')})"
    return f"list_transform(range(1, len(m{k}) + 1), lambda i: {{'s': {start}::int, 'k': {k}, 'e': ({start} + length(m{k}[i]))::int, 'f': m{k}[i]}})"


def secrets(max_owners: int = 2, max_repos: int = 20) -> str:
    pats = [p.replace("'", "''") for p in (ASSIGN, ACCESS, HEX, CANDIDATE)]
    parts = ", ".join(f"regexp_extract_all(t, '{p}') m{k}, string_split_regex(t, '{p}') p{k}" for k, p in enumerate(pats))
    said = "array_to_string(list_transform(list_sort({x}), lambda y: ['assign', 'access', 'hex', 'owned'][y.k + 1] || ':' || y.s || ':' || y.e), ',')"
    return f"""
with t as (select doc_id, source, coalesce(text, '') t from documents), x as (select doc_id, source, {parts} from t),
b as (select doc_id, source, list_filter({_found(0)}, lambda y: length(regexp_extract(y.f, '{pats[0]}', 1)) >= 8) || list_filter({_found(1)}, lambda y: length(y.f) >= 16) || {_found(2)} base,
 list_filter({_found(3)}, lambda y: regexp_matches(y.f, '[0-9]') and regexp_matches(y.f, '[A-Za-z]') and len(list_distinct(string_split(y.f, ''))) >= 10) more from x),
o as (select doc_id, source, base || list_filter(more, lambda m: len(list_filter(base, lambda y: y.s < m.e and m.s < y.e)) = 0) every from b),
v as (select doc_id, source, unnest(every) y from o), u as (select *, case when y.k = 0 then regexp_extract(y.f, '{pats[0]}', 1) else y.f end val from v),
q as (select val, count(distinct source) > {max_owners} or count(distinct doc_id) > {max_repos} copied from u group by val),
j as (select doc_id, list_distinct(list({{'s': y.s, 'k': y.k, 'e': y.e}})) spans from u join q using (val) where y.k < 3 or not copied group by doc_id),
z as (select doc_id, coalesce(spans, []) spans from t left join j using (doc_id))
select doc_id, len(list_filter(spans, lambda y: y.k = 0)) n_assign, len(list_filter(spans, lambda y: y.k = 1)) n_access, len(list_filter(spans, lambda y: y.k = 2)) n_hex,
 sha256({said.format(x="list_filter(spans, lambda y: y.k < 3)")}) base_sha256, {said.format(x="spans")} spans from z"""


def quality(strata: tuple[str, ...] = ("en", "de", "fr", "es"), alpha: float = 0.04, delta: float = 0.05, cost: float = 10.0) -> str:
    word = r"[^\x20\x09-\x0D]"
    grid = ", ".join(f"('{r}', {j}, {c!r}::double)" for r, (_, _, cuts) in RULES.items() for j, c in enumerate(cuts))
    metric = " union all ".join(f"select doc_id, stratum, failed, '{r}' rule, {k} nth, coalesce({a} / nullif({b}, 0), 0)::double x from f" for k, (r, (a, b, _)) in enumerate(RULES.items()))
    tests = len(RULES) * (len(strata) + 1)
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha / len(RULES)!r}) + (n - i) * ln(1 - {alpha / len(RULES)!r}))))"
    return f"""
with d as (select doc_id, case when lang in {strata} then lang else '' end stratum, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{word}+') w from documents),
ln as (select doc_id, count(*) n_lines, count(*) - count(distinct x) n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) x from d) where regexp_matches(x, '{word}') group by doc_id),
g as (select doc_id, i, count(*) over (partition by doc_id, key) c from (select doc_id, unnest(range(1, len(w) - 1)) i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) key from d where len(w) > 2)),
rp as (select doc_id, count(distinct pos) n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) pos from g where c > 1) group by doc_id),
s as (select doc_id, stratum, t, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols,
 coalesce(n_lines, 0) n_lines, coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words from d left join ln using (doc_id) left join rp using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words failed from s), m as ({metric}),
lb as (select doc_id, max(quality) good from labels where quality is not null group by doc_id), gr(rule, j, cut) as (values {grid}),
tr as (select stratum, t, max(good) good, min(doc_id) doc_id from f join lb using (doc_id) where not failed group by stratum, t),
h as (select m.stratum, m.rule, j, cut, count(*) filter (good = 1 and x > cut) k, count(*) filter (good = 1) n, count(*) filter (good = 0 and x > cut) bad from m join tr on tr.doc_id = m.doc_id join gr on gr.rule = m.rule group by all),
ok as (select *, bad - {cost} * k gain, bool_and(n > 0 and {tail} <= {delta / tests!r}) over (partition by stratum, rule order by j) fine from h),
c as (select stratum, rule, cut from ok where fine and gain > 0 qualify row_number() over (partition by stratum, rule order by gain desc, j) = 1),
z as (select doc_id, string_agg(m.rule, ',' order by nth) reasons from m join c on c.rule = m.rule and c.stratum = m.stratum where not failed and x > cut group by doc_id)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed base_failed, not failed and z.doc_id is null kept, coalesce(reasons, '') reasons from f left join z using (doc_id)"""


URLS = rf"""
with recursive u as (select page_id, case when coalesce(url, '') like '%://%' then substr(url, instr(url, '://') + 3) else '' end rest from pages),
p as (select page_id, {_LOWER % "regexp_extract(rest, '^([^/?#]*)', 1, 's')"} host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') path from u),
q as (select *, case when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
 when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
 when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/' when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
 when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end rule from p),
s as (select *, case when rule in ('com/', 'www.example.com/en/') then 0 when rule is not null then 1 end bad,
 case when path = '' then [] else list_transform(string_split(substr(path, 2), '/'), lambda x: case when regexp_matches(x, '[0-9]') or length(x) >= 40 or x = '~' then '*' else x end) end seg from q),
leaves as (select host, seg, count(*) n, count(bad) l, coalesce(sum(bad), 0)::bigint b from s group by host, seg),
tree as (select 0 d, host, seg, n, l, b, '' prefix from leaves union all
 select d + 1, host, seg, n, l, b, prefix || '/' || case when apart or lone then name else '~' end from
 (select *, min(name) filter (not apart) over w = max(name) filter (not apart) over w lone from
  (select *, coalesce(bl >= 5 and al - bl >= 5 and ab > 0 and ab < al and abs(bb / bl - (ab - bb) / (al - bl)) / sqrt(ab / al * (1 - ab / al) * (1 / bl + 1 / (al - bl))) >= 1.96, false) apart from
   (select *, sum(l) over v bl, sum(b) over v bb, sum(l) over w al, sum(b) over w ab from
    (select *, case when here = '*' or sum(n) over (partition by host, prefix, here) < 0.02::double * sum(n) over (partition by host, prefix) then '*' else here end name from
     (select *, seg[d + 1] here from tree where len(seg) > d)) window v as (partition by host, prefix, name), w as (partition by host, prefix))) window w as (partition by host, prefix))),
whole as (select * from tree where len(seg) = d), r as (select coalesce(sum(b) / nullif(sum(l), 0), 0)::double rate from leaves),
nodes as (select host, prefix, sum(l)::bigint labelled, case when sum(l) > 0 then (sum(b) + 4.0::double * any_value(rate)) / (sum(l) + 4.0::double) else any_value(rate) end purity from whole, r group by host, prefix)
select page_id, s.host, path, rule, coalesce(case bad when 1 then 'block' when 0 then 'allow' end, case when labelled > 0 and purity >= 0.9::double then 'block' else 'allow' end) verdict, t.prefix template, labelled, round(purity, 6) purity
from s join whole t on t.host = s.host and t.seg = s.seg join nodes x on x.host = t.host and x.prefix = t.prefix"""

ORACLES = {"op4_url_filter": URLS, "op2_quality_rules": quality(), "op3_minhash_near_dedup": NEAR, "op7_secret_scan": secrets(), "op10_line_dedup": LINES}
