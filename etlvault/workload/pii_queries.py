"""PII queries over the whole texts of documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from etlvault.operators import pii
from etlvault.workload.tables import wide

RUN_TS = "2024-01-02 00:00:00"
KEY_ID, TEST_KEY = "key_20240102", "0123456789abcdef"


def cells(spark, sf_dir):
    return pii.detect(wide(spark, sf_dir, "documents"), "doc_id")


def turn_cells(spark, sf_dir):
    """Hits in conversation turns, at the lower single threshold."""
    turns = wide(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text", "role")
    return pii.detect(turns, "turn_id", ["text", "role"], threshold=pii.GLOBAL_THRESHOLD)


def column_summary(spark, sf_dir):
    documents = wide(spark, sf_dir, "documents")
    return pii.column_summary(pii.detect(documents, "doc_id"), documents, "documents", RUN_TS)


def flagged_columns(spark, sf_dir):
    """The report of columns with a hit at or above the high confidence, best first."""
    found = pii.flagged_columns(column_summary(spark, sf_dir))
    return found.select("column_name", "detected_entity_types", "avg_confidence", "max_confidence", "n_flagged_rows")


def high_confidence(spark, sf_dir):
    return pii.detect(wide(spark, sf_dir, "documents"), "doc_id").filter(
        F.col("confidence") >= pii.HIGH_CONFIDENCE).groupBy("entity_type").agg(F.count("*").alias("hits"))


def _contacts(spark, sf_dir):
    """One cell per contact found in a text line, so that masks keep a recognisable shape."""
    lines = wide(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return lines.select(F.concat_ws(":", "doc_id", "line").alias("line_id"), "value")


def masked(spark, sf_dir):
    found = pii.anonymise(_contacts(spark, sf_dir), "documents", RUN_TS, "line_id", ["value"])
    return found.select("dataset_name", "run_timestamp", "row_index", F.md5("value").alias("masked_md5"))


def registry(spark, sf_dir):
    documents = wide(spark, sf_dir, "documents")
    sealed = pii.vault_cells(documents, "doc_id", "documents", RUN_TS, KEY_ID, TEST_KEY)
    return pii.key_registry(spark, sealed, "documents", RUN_TS, KEY_ID, TEST_KEY)


def roundtrip(spark, sf_dir):
    """Mask and encrypt all document texts, restore them and count what differs."""
    documents = wide(spark, sf_dir, "documents").select("doc_id", "text", "source")
    names = ["text", "source"]
    sealed = pii.vault_cells(documents, "doc_id", "documents", RUN_TS, KEY_ID, TEST_KEY, names)
    hidden = pii.anonymise(documents, "documents", RUN_TS, "doc_id", names)
    back = pii.restore(hidden, "doc_id", sealed, names, TEST_KEY)
    return pii.roundtrip_check(documents, back, "doc_id", names)


QUERIES = {
    "pii_cells": cells, "pii_turn_cells": turn_cells, "pii_column_summary": column_summary, "pii_flagged_columns": flagged_columns,
    "pii_high_confidence": high_confidence, "pii_masked": masked, "pii_key_registry": registry, "pii_roundtrip": roundtrip,
}


def _hits_sql(source: str) -> str:
    """Hits with spans: runs and gaps of each token pattern, summed up in order."""
    parts = []
    for i, r in enumerate(pii.RECOGNISERS):
        token = r.pattern.replace("++", "+").replace("*+", "*")  # SQL has no possessive form
        accept = "" if r.anchor else r.accept
        accepted = f"regexp_matches(x, '{accept}')" if accept else "true"
        # texts without an accepted candidate need no spans
        parts.append(f"""
          select * from (select row_id, column_name, v, '{r.entity}' as entity_type, {i} as priority, {r.score} as score, {r.weak_score} as weak,
                 '{accept}' as accept, regexp_extract_all(v, '{token}') as runs, regexp_split_to_array(v, '{token}') as gaps
          from ({source})) where len([x for x in runs if {accepted}]) > 0""")
    return f"""
runs as ({' union all '.join(parts)}),
pos as (
  select row_id, column_name, entity_type, priority, score, weak, accept, unnest(runs) as run,
         unnest([length(gaps[x]) for x in range(1, len(runs) + 1)]) as gap,
         unnest(range(1, len(runs) + 1)) as i from runs),
spans as (
  select *, sum(gap + length(run)) over (partition by row_id, column_name, entity_type order by i) as e from pos),
digits as (
  select *, [cast(substr(reverse(regexp_replace(run, '[^0-9]', '', 'g')), x, 1) as int)
       for x in range(1, length(regexp_replace(run, '[^0-9]', '', 'g')) + 1)] as d
  from spans where regexp_matches(run, accept)),
hits as (
  select row_id, column_name, entity_type, priority, e - length(run) as s, e,
    case entity_type
      when 'CREDIT_CARD' then case when list_sum([case when x % 2 = 1 then d[x]
           when d[x] * 2 > 9 then d[x] * 2 - 9 else d[x] * 2 end for x in range(1, len(d) + 1)]) % 10 = 0 then score else weak end
      when 'IP_ADDRESS' then case when list_max([cast(x as int) for x in string_split(run, '.')]) <= 255 then score else weak end
      else score end as confidence
  from digits)"""


_DOC = ("select doc_id as row_id, 'text' as column_name, text as v from documents"
        " union all select doc_id, 'lang', lang from documents union all select doc_id, 'source', source from documents")
_LIMIT = "confidence >= case entity_type when 'DATE_TIME' then 0.6 else 0.5 end"
_LINES = ("select cast(doc_id as varchar) || ':' || cast(i - 1 as varchar) as row_id, 'value' as column_name, v from ("
          "select doc_id, unnest(string_split(text, chr(10))) as v, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)")

_SUMMARY = f"""
        with {_hits_sql(_DOC)},
        f as (select column_name, string_agg(distinct entity_type, ', ' order by entity_type) as types, count(distinct entity_type) as k,
                avg(confidence) as a, max(confidence) as hi, min(confidence) as lo, count(distinct row_id) as n from hits where {_LIMIT} group by 1),
        b as (select 'text' as column_name, count(text) as m from documents union all select 'lang', count(lang) from documents
              union all select 'source', count(source) from documents)
        select 'documents' as dataset_name, '{RUN_TS}' as run_timestamp, b.column_name, types is not null as is_pii, types as detected_entity_types,
               cast(coalesce(k, 0) as int) as n_entity_types, cast(round(a, 6) as double) as avg_confidence, cast(hi as double) as max_confidence,
               cast(lo as double) as min_confidence, coalesce(n, 0) as n_flagged_rows,
               cast(round(coalesce(n, 0) * 100.0 / m, 4) as double) as pct_flagged_rows, 'mask + encrypt' as anonymization_method
        from b left join f using (column_name)"""

ORACLE = {
    "pii_cells": f"""with {_hits_sql(_DOC)}
        select column_name, row_id, entity_type, cast(confidence as double) as confidence, cast(s as int) as start_char, cast(e as int) as end_char
        from hits where {_LIMIT}""",
    "pii_turn_cells": f"""
        with {_hits_sql("select cast(conv_id as varchar) || ':' || cast(turn as varchar) as row_id, unnest(['text', 'role']) as column_name, unnest([text, role]) as v from conversations")}
        select column_name, row_id, entity_type, cast(confidence as double) as confidence, cast(s as int) as start_char, cast(e as int) as end_char
        from hits where confidence >= 0.4""",
    "pii_column_summary": _SUMMARY,
    "pii_flagged_columns": f"""select column_name, detected_entity_types, avg_confidence, max_confidence, n_flagged_rows
        from ({_SUMMARY}) where is_pii and max_confidence >= 0.85""",
    "pii_high_confidence": f"""with {_hits_sql(_DOC)}
        select entity_type, count(*) as hits from hits where {_LIMIT} and confidence >= 0.85 group by 1""",
    "pii_masked": f"""
        with {_hits_sql(_LINES)},
        first as (select row_id, min_by(entity_type, (s, priority)) as entity from hits where {_LIMIT} group by 1),
        x as (select l.row_id, l.v, entity, regexp_replace(l.v, '[^0-9]', '', 'g') as d, regexp_replace(l.v, '[- ]', '', 'g') as c,
                case when length(l.v) <= 2 then repeat('*', length(l.v)) else left(l.v, 1) || repeat('*', length(l.v) - 2) || right(l.v, 1) end as g
              from ({_LINES}) l left join first f using (row_id))
        select 'documents' as dataset_name, '{RUN_TS}' as run_timestamp, row_id as row_index, md5(case
            when entity is null then v
            when entity = 'EMAIL_ADDRESS' then repeat('*', instr(v, '@') - 1) || substr(v, instr(v, '@'))
            when entity = 'CREDIT_CARD' then repeat('*', greatest(length(c) - 4, 0)) || right(c, 4)
            when entity = 'US_SSN' then '***-**-' || right(v, 4)
            when entity = 'PHONE_NUMBER' then repeat('*', length(d) - 4) || right(d, 4)
            when entity = 'IP_ADDRESS' then case when len(string_split(v, '.')) = 4 then '*.*.*.' || string_split(v, '.')[4] else '*.*.*.*' end
            else g end) as masked_md5
        from x""",
    "pii_key_registry": f"""
        with {_hits_sql(_DOC)}
        select 'documents' as dataset_name, '{RUN_TS}' as run_timestamp, '{KEY_ID}' as key_id, sha256('{TEST_KEY}') as key_fingerprint,
               string_agg(distinct entity_type, ', ' order by entity_type) as entities_covered from hits where {_LIMIT}""",
    "pii_roundtrip": """
        select 'text' as column_name, count(text) as cells, cast(0 as bigint) as mismatches from documents
        union all select 'source', count(source), 0 from documents""",
}
