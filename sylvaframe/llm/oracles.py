"""DuckDB twins of the queries that SQL can express: license scan, repeated strings, top-k search and quality rules.

They compute the results by plain definitions (all windows, all pairs, all templates), so they are for small tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from . import license_scan, quality_rules
from .suffix_dedup import LENGTH

_WORD = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: Iterable[str]) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def license_scan_sql(least: float = license_scan.MIN_DICE) -> str:
    templates = ", ".join(f"({_text(name)}, {_text(t)})" for name, texts in license_scan.TEMPLATES.items() for t in texts)
    words = "list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    grams = "list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"

    numbers = "list_filter({x}, lambda y: regexp_matches(y, ' [0-9]+$'))"
    left = lambda x: f"split_part({x}, ' ', 1)"
    # no word of the template that a number follows is followed by other numbers only
    agrees = f"len(list_filter(t_nums, lambda x: len(list_filter(nums, lambda y: {left('y')} = {left('x')})) > 0 and len(list_filter(t_nums, lambda z: {left('z')} = {left('x')} and list_contains(nums, z))) = 0)) = 0"

    def best(units: str, where: str = "true") -> str:
        """Best license of each unit of a table units(doc_id, line, part, unit)."""
        return f"""
        select doc_id, line, part, max(score) as score, arg_min(name, struct_pack(s := -score, n := name)) as name from (
          select u.doc_id, u.line, u.part, t.name, u.nums, t.nums as t_nums, 2 * len(list_intersect(u.g, t.g)) / (len(u.g) + len(t.g)) as score
          from (select *, {numbers.format(x="g")} as nums from (select doc_id, line, part, {grams} as g from (select *, {words.format(x="unit")} as w from {units} where {where}))) u
          join templates t on list_has_any(u.g, t.g)) where score >= {least} and case when score >= {least} then {agrees} end group by all"""

    return f"""
    with templates as (select *, {numbers.format(x="g")} as nums from (select name, {grams} as g from (select name, {words.format(x="text")} as w from (values {templates}) as v(name, text)))),
    docs as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
    lines as (select row as doc_id, unnest(range(len(l))) as line, 0 as part, unnest(l) as unit from (select row, string_split(text, chr(10)) as l from docs)),
    by_line as ({best("lines")}),
    sentences as (select doc_id, line, unnest(range(len(s))) as part, unnest(s) as unit from (
      select l.doc_id, l.line, string_split(regexp_replace(l.unit, '([.!?;:])[ \\t]+', '\\1' || chr(1), 'g'), chr(1)) as s
      from lines l) where len(s) > 1),
    all_sentences as ({best("sentences")}),
    by_sentence as (select s.* from all_sentences s left join by_line b on b.doc_id = s.doc_id and b.line = s.line where b.name is distinct from s.name),
    found as (select * from by_line union all select * from by_sentence),
    wholes as (select row as doc_id, 0 as line, 0 as part, text as unit from docs where contains(text, chr(10)) and row not in (select doc_id from found)),
    hits as (select * from found union all {best("wholes")}),
    per as (select doc_id as row, count(*) as n, max(score) as score, arg_min(name, struct_pack(s := -score, n := name)) as name from hits group by 1)
    select d.doc_id, coalesce(p.n, 0)::bigint as n_matches, p.name as best_license, p.score::double as best_score from docs d left join per p using (row)"""


def suffix_dedup_sql(length: int = LENGTH) -> str:
    return f"""
    with d as materialized (select row_number() over () as row, doc_id, encode(coalesce(text, '')) as b from documents),
    w as materialized (select row, doc_id, p, array_slice(b, p + 1, p + {length}) as s from (select *, unnest(range(octet_length(b) - {length - 1})) as p from d)),
    m as (select s, min(doc_id) as first from w group by 1 having min(doc_id) < max(doc_id)),
    gone as (select row, p from w join m using (s) where first < doc_id),
    cut as (select row, p, case when p > lag(p) over (partition by row order by p) + {length} then 1 else 0 end as new from gone),
    runs as (select row, min(p) as lo, max(p) + {length} as hi from (select row, p, sum(new) over (partition by row order by p) as run from cut) group by row, run),
    gaps as (select row, lo, hi, coalesce(lag(hi) over (partition by row order by lo), 0) as before from runs),
    kept as (select g.row, string_agg(hex(array_slice(b, before + 1, lo)), '' order by lo) as head, max(hi) as hi, sum(hi - lo) as n_removed, count(*) as n_spans from gaps g join d using (row) group by 1)
    select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
    sha256(unhex(coalesce(head, '') || hex(array_slice(b, coalesce(hi, 0) + 1, octet_length(b))))) as kept_sha256 from d left join kept using (row)"""


def top_k_sql(k: int = 10) -> str:
    bit = "(coalesce({x}[i], 0) > 0)"
    return f"""
    select query_id, rank::int as rank, neighbour_id, distance::int as distance from (
      select q.vec_id as query_id, c.vec_id as neighbour_id, list_sum(list_transform(range(1, 65), lambda i: ({bit.format(x="q.embedding")} <> {bit.format(x="c.embedding")})::int)) as distance,
      row_number() over (partition by q.vec_id order by distance, c.vec_id) as rank
      from embeddings q join embeddings c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0 and q.embedding is not null and c.embedding is not null)
    where rank <= {k}"""


def quality_rules_sql() -> str:
    classes, width = quality_rules.CLASSES, quality_rules.N_COMMON
    counts = ", ".join(f"case when len(listed) > {k} then len(list_filter(w, lambda x: x = listed[{k + 1}])) else 0 end" for k in range(width))
    without = lambda pattern: f"(length(text) - length(regexp_replace(text, '{pattern}', '', 'g')))"
    mark = r"[!\"''()+,\-./:;=?@\[\\\]^_`{}~0-9]"
    half = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: case when {a}[i] > 0 then {a}[i] * log2(2 * {a}[i] / ({a}[i] + {b}[i])) else 0 end))"
    js = lambda p, q: f"sqrt(greatest(0, ({half.format(a=p, b=q)} + {half.format(a=q, b=p)}) / 2))"
    mean = lambda name, n: "[" + ", ".join(f"avg({name}[{i + 1}])" for i in range(n)) + "]"
    shares = ", ".join(f"{c} / length(text)" for c in classes)
    return f"""
    with large as (select lang from documents where lang is not null group by 1 having count(*) >= greatest({quality_rules.MIN_LANG_DOCS}, {quality_rules.MIN_LANG_SHARE} * (select count(*) from documents))),
    texts as (select row_number() over () as row, doc_id, coalesce(text, '') as text, lang, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
    vocabulary as (select lang, word, count(*) as n from (select lang, unnest(list_distinct(w)) as word from texts join large using (lang)) group by 1, 2),
    lists as (select lang, list(word order by n desc, word) as listed from (select * from vocabulary qualify row_number() over (partition by lang order by n desc, word) <= {width}) group by 1),
    d as (select row, doc_id, text, w, coalesce(l.lang, '{quality_rules.OTHER}') as lang, coalesce(listed, []::varchar[]) as listed from texts t left join lists l on l.lang = t.lang),
    grams as (select row, p, w[p:p + 2] as g from (select row, w, unnest(range(1, len(w) - 1)) as p from d)),
    twice as (select row, p from (select row, p, count(*) over (partition by row, g) as n from grams) where n > 1),
    covered as (select row, count(distinct p + o) as n from twice cross join (select unnest([0, 1, 2]) as o) group by 1),
    base as (select d.row, doc_id, text, lang, w, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, {without(quality_rules.SYMBOLS)}::bigint as n_symbol,
      {without(r"\p{Lu}")} as n_upper, {without(mark)} as n_mark, coalesce(n, 0)::bigint as n_repeat_words, listed,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from d left join covered using (row)),
    counted as (select *, word_chars - n_symbol - n_upper - n_mark as n_lower, length(text) - word_chars as n_space, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
      [{counts}] as common, n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words as base_failed from base),
    shares as (select *, case when n_words >= {quality_rules.MIN_CHAR_WORDS} then [{shares}] end as p,
      case when n_words >= {quality_rules.MIN_COMMON_WORDS} and lang <> '{quality_rules.OTHER}' then list_transform(list_append(common, n_words - list_sum(common)), lambda x: x / n_words) end as q from counted),
    means as (select lang, {mean("p", len(classes))} as rp, {mean("q", width + 1)} as rq from shares where not base_failed group by 1),
    judged as (select s.*, case when p is not null then {js("p", "rp")} end as dp, case when q is not null then {js("q", "rq")} end as dq from shares s left join means using (lang)),
    quartiles as (select lang, quantile_cont(floor(dq * {quality_rules.BINS})::int + 1, [0.25, 0.75]) as z from judged where not base_failed and q is not null group by 1),
    limits as (select lang, greatest({quality_rules.LEAST_WORD_LIMIT}, (z[2] + 3 * (z[2] - z[1])) / {quality_rules.BINS}) as word_limit from quartiles)
    select doc_id, n_words, word_chars, n_symbol as n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and coalesce(dp, 0) <= {quality_rules.MAX_CHAR_DISTANCE} and coalesce(dq <= word_limit, true) as kept from judged left join limits using (lang)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan_sql(), "op3_suffix_dedup": suffix_dedup_sql(), "op4_top_k": top_k_sql(), "op9_quality_rules": quality_rules_sql()}
