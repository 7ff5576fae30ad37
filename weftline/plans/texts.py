"""Queries that apply rule tables and text statistics to the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.operators import phrases as P, rules as R
from weftline.operators.rules import Rule
from weftline.plans.base import Tables, query
from weftline.plans.documents import UNITS

#: Rules in the documents' languages. Phrases of one category don't overlap.
RULES = [
    Rule("en-the-of", "opener", "the of", 1, "first"),
    Rule("fr-que-la", "connector", "que la", 2),
    Rule("de-nicht", "connector", "nicht", 3),
    Rule("es-que-de", "connector", "que de", 4),
    Rule("token", "secret", "token = ", 5),
    Rule("digits", "secret", "[0-9]{13,}", 6),
    Rule("licence", "ending", "Licensed under", 7, "last"),
    Rule("of-the", "vague", "of the", 8),
    Rule("and-the", "vague", "and the", 9),
]
#: Lint rules by priority; the later ones overlap the earlier.
LINT = [Rule("long-number", "lint", "[0-9]{13,}", 1), Rule("number", "lint", "[0-9]{5,}", 2), Rule("assignment", "lint", '[a-z]+ = "[0-9a-f]{8}', 3), Rule("doubled-mark", "lint", r"[!?*]{2,}", 4)]
SEVERITY = {("opener", "formal"): "medium", ("opener", "social"): "high", ("secret", "social"): "high", ("secret", "formal"): "high", ("vague", "social"): "low"}

_FIRST, _LAST = f"coalesce(({UNITS})[1], '')", f"coalesce(({UNITS})[-1], '')"


def _count(r: Rule) -> str:
    place = {"any": "text", "first": _FIRST, "last": _LAST}[r.scope]
    return f"len(regexp_extract_all({place}, '{r.pattern}'))"


_HITS = " union all ".join(f"select doc_id, '{r.rule_id}' as rule_id, '{r.category}' as category, {_count(r)} as hits from documents where {_count(r)} > 0" for r in RULES)


@query(_HITS)
def rule_hits(t: Tables) -> DataFrame:
    return R.rule_hits(t.documents, RULES)


@query(" union all ".join(f"select doc_id, '{c}' as category, len(regexp_extract_all(text, '{p}')) as hits from documents where regexp_matches(text, '{p}')" for c in sorted({r.category for r in RULES}) for p in ["|".join(f"(?:{r.pattern})" for r in RULES if r.category == c)]))
def phrase_counts(t: Tables) -> DataFrame:
    return R.category_counts(t.documents, RULES)


@query(f"select * from ({_HITS}) where category in ('opener', 'ending')")
def scoped_hits(t: Tables) -> DataFrame:
    return R.rule_hits(t.documents, [r for r in RULES if r.scope != "any"])


@query(f"select *, case category when 'opener' then 'high' when 'secret' then 'high' when 'vague' then 'low' else 'medium' end as severity from ({_HITS})")
def rule_severity(t: Tables) -> DataFrame:
    return R.severity(R.rule_hits(t.documents, RULES), "social", SEVERITY)


@query("select doc_id, n as n_signals, n >= 3 as template_like from (select doc_id, " + " + ".join(f"regexp_matches(text, '{r.pattern}')::bigint" for r in RULES) + " as n from documents)")
def template_score(t: Tables) -> DataFrame:
    return R.template_score(t.documents, RULES)


@query(f"select doc_id, n as hits, case when length(text) > 0 then round(n * 1000.0 / length(text), 6) end as per_thousand, case when units > 0 then round(n * 1.0 / units, 6) end as per_unit from (select doc_id, text, len(regexp_extract_all(text, 'the|que|der')) as n, len({UNITS}) as units from documents)")
def word_density(t: Tables) -> DataFrame:
    return R.word_density(t.documents, "the|que|der")


@query(f"""
with u as (select doc_id, text, list_transform({UNITS}, lambda x: regexp_matches(x, 'of the')) as f from documents)
select doc_id, hits, consecutive from (select doc_id, len(regexp_extract_all(text, 'of the')) as hits, len(list_filter(range(1, len(f)), lambda i: f[i] and f[i + 1])) > 0 as consecutive from u) where hits > 1 or consecutive""")
def pattern_cap(t: Tables) -> DataFrame:
    return R.pattern_cap(t.documents, "of the")


def _spans(r: Rule) -> str:
    """Starts by what stands before: a match and the gaps before it."""
    p = r.pattern.replace("'", "''")
    return f"""select doc_id, line, {r.priority} as priority, '{r.rule_id}' as rule, hit, start, start + length(hit) as stop from (select doc_id, line, hits[i] as hit, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::bigint as start
  from (select doc_id, line, hits, gaps, unnest(range(1, len(hits) + 1)) as i from (select doc_id, line, regexp_extract_all(body, '{p}') as hits, string_split_regex(body, '{p}') as gaps from lines where regexp_matches(body, '{p}'))))"""


# of the rules here, only the number inside a long number, and numbers inside an assignment's digits, can overlap: each rule is held against those accepted before it
@query(rf"""
with lines as (select doc_id, l[i] as body, i as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as l from documents))),
s1 as ({_spans(LINT[0])}), s2 as ({_spans(LINT[1])}), s3 as ({_spans(LINT[2])}), s4 as ({_spans(LINT[3])}),
a1 as (select * from s1),
a2 as (select * from a1 union all select * from s2 where not exists (select 1 from a1 where a1.doc_id = s2.doc_id and a1.line = s2.line and s2.start < a1.stop and s2.stop > a1.start)),
a3 as (select * from a2 union all select * from s3 where not exists (select 1 from a2 where a2.doc_id = s3.doc_id and a2.line = s3.line and s3.start < a2.stop and s3.stop > a2.start)),
a4 as (select * from a3 union all select * from s4 where not exists (select 1 from a3 where a3.doc_id = s4.doc_id and a3.line = s4.line and s4.start < a3.stop and s4.stop > a3.start))
select doc_id, line, start + 1 as "column", rule, hit as "match" from a4""")
def line_lint(t: Tables) -> DataFrame:
    return R.lint(t.documents, LINT)


#: Connectors of the documents' languages.
CONNECTORS = r"(?:^|[^\p{L}])(?:and|but|or|und|oder|aber|et|mais|ou|y|pero)(?:$|[^\p{L}])"


def _top(name: str, rows: str) -> str:
    return f"{name} as (select source, string_agg(w, ' ' order by r) as {name} from (select source, w, row_number() over (partition by source order by count(*) desc, w) as r from ({rows}) group by source, w) where r <= 5 group by source)"


@query(rf"""
with u as (select source, unnest({UNITS}) as x from documents),
n as (select source, count(*) as n_units, round(avg(length(x)), 4) as mean_length, round(stddev_samp(length(x)), 4) as dev_length, round(avg(len(regexp_extract_all(x, '{CONNECTORS}'))), 4) as connectors from u group by source),
{_top("top_words", r"select source, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) as w from documents")},
{_top("openings", r"select * from (select source, regexp_extract(lower(x), '[\p{L}]+') as w from u) where w <> ''")},
{_top("endings", "select source, x[-1] as w from u")}
select n.*, c.confident, top_words, openings, endings from n join (select source, sum(length(text)) >= 150 as confident from documents group by source) c using (source) left join top_words using (source) left join openings using (source) left join endings using (source)""")
def style_fingerprint(t: Tables) -> DataFrame:
    return R.style_fingerprint(t.documents, "source", connectors=CONNECTORS)


#: Words of the documents and the Chinese phrases that stand for them in what the next queries read.
CHINESE = {"of the": "众所周知，根据用户提供的素材中提到", "que": "赋能闭环", "nicht": "不仅快，更好", "was": "从这份素材中可以看出", "in the": "我整理了 4 个判断", "est": "普通人最该学的是", "from": "不是快，而是稳", "und": "检索结果表明，原始素材显示"}


def chinese(t: Tables) -> DataFrame:
    """The documents with some words replaced by Chinese phrases."""
    body = F.col("text")
    for word, phrase in CHINESE.items():
        body = F.replace(body, F.lit(f" {word} "), F.lit(phrase))
    return t.documents.select("doc_id", body.alias("text"))


def _chinese_sql() -> str:
    body = "text"
    for word, phrase in CHINESE.items():
        body = f"replace({body}, ' {word} ', '{phrase}')"
    return f"select doc_id, {body} as text from documents"


_JOINT = {c: "|".join(f"(?:{r.pattern})" for r in P.phrase_rules() if r.category == c) for c in sorted({r.category for r in P.phrase_rules()})}


@query(f"with d as materialized ({_chinese_sql()}) " + " union all ".join(f"select doc_id, '{c}' as category, len(regexp_extract_all(text, '{p}')) as hits from d where regexp_matches(text, '{p}')" for c, p in _JOINT.items()))
def worn_phrases(t: Tables) -> DataFrame:
    """Worn Chinese phrases by category."""
    return R.category_counts(chinese(t), P.phrase_rules())


@query(f"with d as materialized ({_chinese_sql()}) " + " union all ".join(f"select doc_id, '{r.rule_id}' as rule_id, '{r.category}' as category, len(regexp_extract_all(text, '{r.pattern}')) as hits from d where regexp_matches(text, '{r.pattern}')" for r in P.phrase_rules()))
def phrase_table(t: Tables) -> DataFrame:
    """All phrases as a table of rules, found by their anchors."""
    return R.rule_hits(chinese(t), P.phrase_rules())


@query(f"select doc_id, n as n_signals, n >= 3 as template_like from (select doc_id, " + " + ".join(f"regexp_matches(text, '{r.pattern}')::bigint" for r in P.template_rules()) + f" as n from ({_chinese_sql()}))")
def chinese_template(t: Tables) -> DataFrame:
    return R.template_score(chinese(t), P.template_rules())


def _accepted() -> str:
    """Each rule's spans that overlap none of those accepted before it."""
    out = [f"s{i} as ({_spans(r)})" for i, r in enumerate(P.SOURCE_TALK)] + ["a0 as (select * from s0)"]
    for i in range(1, len(P.SOURCE_TALK)):
        out.append(f"a{i} as (select * from a{i - 1} union all select * from s{i} s where not exists (select 1 from a{i - 1} a where a.doc_id = s.doc_id and a.line = s.line and s.start < a.stop and s.stop > a.start))")
    return ",\n".join(out)


@query(rf"""
with lines as materialized (select doc_id, l[i] as body, i as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as l from ({_chinese_sql()})))),
{_accepted()}
select doc_id, line, start + 1 as "column", rule, hit as "match" from a{len(P.SOURCE_TALK) - 1}""")
def source_talk(t: Tables) -> DataFrame:
    """Wording that speaks of the material behind a text."""
    return R.lint(chinese(t), P.SOURCE_TALK)


def _rewritten(t: Tables) -> DataFrame:
    """Documents beside rewrites in which runs of three digits or more are rounded, and the mark ``Licensed`` is gone."""
    return t.documents.select("doc_id", F.col("text").alias("before"), F.regexp_replace(F.regexp_replace("text", "([0-9]{2})[0-9]", "$10"), "Licensed", "licensed").alias("after"))


def _drift_sql(pattern: str) -> str:
    found = lambda c: f"list_distinct(regexp_extract_all({c}, '{pattern}'))"
    text = lambda a, b: f"array_to_string(list_sort(list_filter({found(a)}, lambda x: not list_contains({found(b)}, x))), ' ')"
    return f"select * from (select doc_id, {text('before', 'after')} as lost, {text('after', 'before')} as added from (select doc_id, text as before, regexp_replace(regexp_replace(text, '([0-9]{{2}})[0-9]', '\\10', 'g'), 'Licensed', 'licensed', 'g') as after from documents)) where lost <> '' or added <> ''"


@query(_drift_sql("[0-9]+"))
def fact_drift(t: Tables) -> DataFrame:
    return R.drift(_rewritten(t), "[0-9]+", "before", "after", "doc_id")


@query(_drift_sql("[A-Z][A-Za-z0-9]*[0-9A-Z][A-Za-z0-9]*|Licensed|Apache"))
def token_preservation(t: Tables) -> DataFrame:
    return R.drift(_rewritten(t), "[A-Z][A-Za-z0-9]*[0-9A-Z][A-Za-z0-9]*|Licensed|Apache", "before", "after", "doc_id")
