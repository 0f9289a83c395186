"""DuckDB SQL for the operators, written from their sequential definitions."""

from __future__ import annotations

import string

from .. import wordlists
from ..functions.text import PIECE, WORD
from ..sources import rdf
from .dictionaries import LONGEST, TOP


def quoted(terms) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in terms)


def tokens(name: str, source: str, key: str = "doc_id", text: str = "text") -> str:
    """CTEs that end in ``name``: (key, pos, start, end, token)."""
    return f"""
    {name}_cut as (select {key}, unnest(p) as piece, generate_subscripts(p, 1) as i
        from (select {key}, regexp_extract_all({text}, '{PIECE}') as p from {source})),
    {name}_placed as (select *, (sum(length(piece)) over (partition by {key} order by i))::int as e from {name}_cut),
    {name}_kept as (select {key}, i, e, case when i > 1 and starts_with(piece, ' ') then substr(piece, 2) else piece end as token from {name}_placed),
    {name} as (select {key}, (row_number() over (partition by {key} order by i) - 1)::int as pos, (e - length(token))::int as start, e as "end", token
        from {name}_kept where token <> '')"""


def lower_root(token: str) -> str:
    return f"lower({token})"


def s_root(token: str) -> str:
    t = f"lower({token})"
    return f"""case when {t} like '%ies' and {t} not like '%eies' and {t} not like '%aies' then substr({t}, 1, length({t}) - 3) || 'y'
        when {t} like '%es' and {t} not like '%aes' and {t} not like '%ees' and {t} not like '%oes' then substr({t}, 1, length({t}) - 1)
        when {t} like '%s' and {t} not like '%us' and {t} not like '%ss' then substr({t}, 1, length({t}) - 1) else {t} end"""


def prefix_root(token: str) -> str:
    return f"substr(lower({token}), 1, 5)"


NORMAL = r"lower(regexp_replace(label, '[\p{C}\p{M}\p{P}\p{S}]+', ' ', 'g'))"


def soundex(token: str) -> str:
    """Letters to codes, other characters to 0, h and w left out; runs of a code are one."""
    upper = f"translate({token}, '{string.ascii_lowercase}', '{string.ascii_uppercase}')"
    coded = f"translate(regexp_replace(substr({upper}, 2), '[^A-Z]', '0', 'g'), '{string.ascii_uppercase}', '01230127022455012623017202')"
    first = f"replace(translate(substr({upper}, 1, 1), '{string.ascii_uppercase}', '01230127022455012623017202'), '7', '0')"
    runs = f"{first} || replace({coded}, '7', '')"
    for digit in "123456":
        runs = f"regexp_replace({runs}, '{digit}+', '{digit}', 'g')"
    return f"case when regexp_matches({token}, '^[A-Za-z]') then substr({upper}, 1, 1) || substr(replace(substr({runs}, 2), '0', '') || '000', 1, 3) else {token} end"


def pieces(name: str, source: str, key: str = "doc_id", text: str = "text") -> str:
    """As ``tokens``, for the word pieces of ``dictionaries.word_pieces``."""
    return f"""
    {name}_word as (select {key}, unnest(p) as w, generate_subscripts(p, 1) as i from (select {key}, string_split({text}, ' ') as p from {source})),
    {name}_at as (select *, (coalesce(sum(length(w) + 1) over (partition by {key} order by i rows between unbounded preceding and 1 preceding), 0))::int as beg from {name}_word),
    {name}_both as (select {key}, i, 0 as part, beg as start, beg + least(length(w), 3) as e, substr(w, 1, 3) as token from {name}_at where w <> ''
        union all select {key}, i, 1, beg + 3, beg + length(w), '##' || substr(w, 4) from {name}_at where length(w) > 3),
    {name} as (select {key}, (row_number() over (partition by {key} order by i, part) - 1)::int as pos, start::int as start, e::int as "end", token from {name}_both)"""


def label_index(labels: str, root=lower_root, language: str = "en", cut=tokens, lists=wordlists.STOP) -> str:
    """CTEs post (root, key, cnt), lens (key, n_tokens) of ``labels``."""
    stop = quoted(lists[language])
    return f"""
    normal as (select concept_id || ':::' || label_index as key, {NORMAL} as text from {labels}),
    {cut("ltok", "normal", "key")},
    lcontent as (select key, {root("token")} as root from ltok where token not in ({stop})),
    post as (select root, key, count(*)::int as cnt from lcontent group by all),
    lens as (select key, sum(cnt)::int as n_tokens from post group by key)"""


def matches(source: str, labels: str, root=lower_root, language: str = "en", key: str = "doc_id", cut=tokens, stops=wordlists.STOP, ends=wordlists.TERMINATION) -> str:
    """CTEs that end in ``ann``: (key, concept_id, label_index, start, end, matched_length).

    Walks token by token from every start, as the definition does. ``labels``
    names a CTE or table.
    """
    stop, terms = quoted(stops[language]), quoted(ends[language])
    return f"""
    {label_index(labels, root, language, cut, stops)},
    {cut("tok", source, key)},
    cls as (select *, token in ({stop}) as is_stop, trim(token) in ({terms}) as is_term from tok),
    numbered as (select *, sum(is_term::int) over (partition by {key} order by pos) as seg from cls),
    content as (select {key} as k, seg, row_number() over (partition by {key} order by pos) as cpos, start, "end" as e, {root("token")} as root from numbered where not is_stop and not is_term),
    roots as (select root, list(key order by key) as keys, list(key order by key) filter (cnt >= 2) as dups from post group by root),
    hit as (select c.*, r.keys, coalesce(r.dups, []) as dups from content c join roots r using (root)),
    walk as (
        select k, seg, cpos as first, cpos as cur, start, e, root as root0, keys, 1 as m from hit
        union all
        select w.k, w.seg, w.first, n.cpos, w.start, n.e, w.root0, list_intersect(w.keys, n.keys), w.m + 1
        from walk w join hit n on n.k = w.k and n.seg = w.seg and n.cpos = w.cur + 1
        where len(list_intersect(w.keys, n.keys)) > 0
            and (n.root <> w.root0 or len(list_intersect(list_intersect(w.keys, n.keys), n.dups)) > 0)),
    ended as (select *, row_number() over (partition by k, first order by m desc) as place from walk),
    each as (select k, start, e, m, unnest(keys) as key from ended where place = 1),
    ann as (select k as {key}, split_part(each.key, ':::', 1) as concept_id, split_part(each.key, ':::', 2)::int as label_index, start, e as "end", m::int as matched_length
        from each join lens using (key) where lens.n_tokens = each.m)"""


_LEADS = ", ".join(f"lead(w, {k}) over (partition by doc_id order by i) as w{k}" for k in range(1, LONGEST))


def _gram(n: int) -> str:
    return " || ' ' || ".join(["w", *[f"w{k}" for k in range(1, n)]])


#: CTEs that end in ``terms``: the frequent n-grams of the documents.
TERMS = f"""
    ws as (select doc_id, unnest(p) as w, generate_subscripts(p, 1) as i from (select doc_id, regexp_extract_all(lower(text), '[{WORD}]+') as p from documents)),
    led as (select w, {_LEADS} from ws),
    grams as ({" union all ".join(f"select {n} as n, {_gram(n)} as label from led" for n in range(1, LONGEST + 1))}),
    counted as (select n, label, count(*) as c from grams where label is not null group by all),
    ranked as (select *, row_number() over (partition by n order by c desc, label) as r from counted),
    terms as (select 'g_' || n || '_' || r as concept_id, 0 as label_index, label from ranked where r <= {TOP})"""

PLURALS = "plurals as (select * from terms union all select concept_id, 1, label || 's' from terms)"

PART_NAMES = "names as (select 'p' || min(p_partkey) as concept_id, 0 as label_index, p_name as label from part group by p_name)"
PART_TEXTS = "parts as (select p_partkey as doc_id, p_name as text from part)"
BRANDS = """brand as (select p_partkey as ord, 'http://example.org/brand_' || p_brand as concept_id, p_name as label from part),
    blabels as (select concept_id, (row_number() over (partition by concept_id order by ord) - 1)::int as label_index, label, ord from brand)"""

_S = "'http://example.org/part_' || p_partkey"
_TYPE, _SKOS, _XL = f"'{rdf.TYPE}'", rdf.SKOS, rdf.SKOS_XL
TRIPLES = f"""triples as (
    select {_S} as s, {_TYPE} as p, '{_SKOS}Concept' as o, null as o_lang from part
    union all select {_S}, '{_SKOS}prefLabel', p_name, 'en' from part
    union all select {_S}, '{_SKOS}altLabel', p_type, 'en' from part
    union all select {_S}, '{_SKOS}altLabel', p_brand, 'fr' from part
    union all select {_S}, '{_XL}prefLabel', {_S} || '/pref', null from part
    union all select {_S} || '/pref', '{_XL}literalForm', p_name, 'en' from part
    union all select {_S}, '{_XL}altLabel', {_S} || '/alt', null from part
    union all select {_S} || '/alt', '{_XL}literalForm', p_type, 'fr' from part)"""


def plain(kind: str, language: str) -> str:
    return f"""select t.s as x, l.o as lf from triples t join triples l on l.s = t.s
        where t.p = {_TYPE} and t.o = '{_SKOS}Concept' and l.p = '{_SKOS}{kind}' and l.o_lang = '{language}'"""


def xl(kind: str, language: str) -> str:
    return f"""select t.s as x, f.o as lf from triples t join triples n on n.s = t.s join triples f on f.s = n.o
        where t.p = {_TYPE} and t.o = '{_SKOS}Concept' and n.p = '{_XL}{kind}' and f.p = '{_XL}literalForm' and f.o_lang = '{language}'"""
