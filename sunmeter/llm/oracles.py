"""The queries in DuckDB SQL."""

from __future__ import annotations

from sunmeter.llm import licenses

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
with words as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}'))
           as lines
  from documents),
places as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from words),
windows as (
  select doc_id, i, word, lead(word) over d as second, lead(word, 2) over d as third
  from places window d as (partition by doc_id order by i)),
repeated as (
  select doc_id, i, count(*) over (partition by doc_id, word, second, third) as times
  from windows where third is not null),
covered as (
  select doc_id, count(distinct place) as n from (
    select doc_id, unnest([i, i + 1, i + 2]) as place from repeated where times > 1)
  group by doc_id),
measured as (
  select words.doc_id, len(w)::bigint as n_words,
         coalesce(list_sum([len(x) for x in w]), 0)::bigint as word_chars,
         (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(covered.n, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') and not regexp_matches(x, '[a-z]')))
           as n_capital
  from words left join covered using (doc_id)),
judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    (case when n_words < 50 then 1 else 0 end)
    + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when 10 * n_symbols > n_words then 4 else 0 end)
    + (case when 2 * n_dup_lines > n_lines then 8 else 0 end)
    + (case when 2 * word_chars < 5 * n_words then 16 else 0 end)
    + (case when word_chars > 12 * n_words then 32 else 0 end)
    + (case when 2 * n_capital > n_words then 64 else 0 end) as bits
  from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       bits = 0 as kept, bits::bigint as failed_bits
from judged
"""


LINES = rf"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i,
         len(string_split(coalesce(text, ''), chr(10))) as n
  from documents),
measured as (
  select *, ('0x' || substr(md5(line), 1, 7))::bigint as h,
         len(regexp_extract_all(line, '{WORD}')) as words
  from lines),
ended as (
  select *, i = n or words > 50 or lead(words, 1, 0) over d > 50
            or (h + 131 * lag(h, 1, 0) over d) % 2147483647 % 2 = 0 as ends
  from measured window d as (partition by doc_id order by i)),
numbered as (
  select *, coalesce(sum(ends::int) over (partition by doc_id order by i
    rows between unbounded preceding and 1 preceding), 0) as chunk
  from ended),
chunks as (
  select doc_id, chunk, string_agg(line, chr(10) order by i) as passage, count(*) as lines,
         count(*) filter (where words > 0) as filled, max(words) > 50 as long
  from numbered group by doc_id, chunk),
compared as (
  select doc_id, chunk, passage, lines,
         case when alone then before || chr(10) || passage else passage end as region,
         filled + case when alone then filled_before else 0 end >= 2 or long as removable
  from (select *, lag(passage) over d as before, lag(filled) over d as filled_before,
               lines = 1 and not long and lag(passage) over d is not null as alone
        from chunks window d as (partition by doc_id order by chunk))),
ranked as (
  select *, removable and row_number() over (partition by region, removable
    order by doc_id, chunk) > 1 as removed
  from compared),
cleaned as (
  select doc_id, count(*) filter (where removed) as n_removed_chunks,
         coalesce(sum(lines) filter (where removed), 0)::bigint as n_removed_lines,
         coalesce(string_agg(passage, chr(10) order by chunk) filter (where not removed), '')
           as text
  from ranked group by doc_id)
select doc_id, n_removed_chunks, n_removed_lines,
       case when documents.text is null then null else cleaned.text end as text
from cleaned join documents using (doc_id)
"""

VECTORS = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as x, b.vec_id as y from v a join v b
    on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95),
reached as (
  select x, y from links
  union
  select reached.x, links.y from reached join links on reached.y = links.x),
smallest as (select x, min(y) as y from reached group by x),
counts as (select x, count(*) as n from links group by x)
select vec_id, coalesce(n, 0)::bigint as n_links,
       least(vec_id, coalesce(smallest.y, vec_id)) as component_id,
       vec_id = least(vec_id, coalesce(smallest.y, vec_id)) as kept
from embeddings left join smallest on smallest.x = vec_id left join counts on counts.x = vec_id
"""


FILL_MIDDLE = """
with units as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u
  from documents),
numbers as (
  select doc_id, text, u, len(u)::bigint as n,
         [('0x' || h[1:8])::bigint, ('0x' || h[9:16])::bigint, ('0x' || h[17:24])::bigint,
          ('0x' || h[25:32])::bigint] as h
  from units),
cuts as (
  select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>')
                or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain'
              when h[4] % 100 < 20 then 'spm' else 'psm' end as form
  from numbers),
parts as (
  select doc_id, n, form, text,
         coalesce(array_to_string(list_slice(u, 1, a), ''), '') as prefix,
         coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') as middle,
         coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') as suffix
  from cuts)
select doc_id, n, form,
       case when form <> 'plain' then length(prefix) end as prefix_chars,
       case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text
                when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""


def _pattern(parts: list[tuple]) -> str:
    """A template as a pattern over words that each end in a space."""
    out = ""
    for part in parts:
        if part[0] == "word":
            out += part[1] + " "
        elif part[0] == "optional":
            out += f"(?:{_pattern(part[1])})?"
        else:
            out += f"(?:[^ ]+ ){{{part[1]},{part[2]}}}"
    return out


def _licenses() -> str:
    places, base, own = [], [], []
    for t in licenses.BASE_PHRASES:
        words = [word for _, word in licenses.parse(t)]
        places.append(" and ".join(
            f"coalesce(w[i + {k}] = '{word}', false)" for k, word in enumerate(words)))
    for templates, out in ((licenses.BASE_PHRASES, base), (licenses.LICENSE_TEMPLATES, own)):
        for t in templates:
            out.append(f"case when regexp_matches(padded, ' {_pattern(licenses.parse(t))}') "
                       f"then '{t.label}' end")

    def labels(cases: list[str]) -> str:
        found = f"list_filter([{', '.join(cases)}], lambda x: x is not null)"
        return f"array_to_string(list_sort(list_distinct({found})), ',')"

    return rf"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '{licenses.LICENSE_WORD}') as w
  from documents),
places as (
  select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as padded,
         list_filter(generate_series(1, len(w)), lambda i: {" or ".join(f"({x})" for x in places)})
           as found
  from words)
select doc_id, len(w)::bigint as n_words, len(found)::bigint as n_base,
       list_min(found)::bigint - 1 as first_word, list_max(found)::bigint - 1 as last_word,
       {labels(base)} as base_labels, {labels(base + own)} as labels,
       case when {labels(own)} <> '' then 1e0 when len(found) > 0 then 0.5e0 else 0e0 end as score
from places
"""


ORACLES = {
    "op1_license_scan": _licenses(), "op3_line_dedup": LINES, "op4_quality_rules": QUALITY,
    "op10_embedding_groups": VECTORS, "op11_fill_middle": FILL_MIDDLE,
}
