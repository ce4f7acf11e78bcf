"""The model's derivation in DuckDB SQL, put before every oracle."""

from __future__ import annotations

from .. import model
from ..functions.text import PUNCTUATION
from ..sources.tables import AS_OF, CITIES, PHRASES


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _contained(markers: list[str]) -> str:
    return f"list_filter({_list(markers)}, lambda m: contains(low, m))"


_VALENCE = " + ".join(f"{v} * len(list_filter(toks, lambda t: list_contains({_list([w for w, x in model.LEXICON.items() if x == v])}, t)))" for v in sorted(set(model.LEXICON.values())))

CTES = f"""posts as (
    select doc_id as post_id, source as source_name, {_list(model.CATEGORIES)}[substr(source, 4)::int % {len(model.CATEGORIES)} + 1] as category, 'ext-' || doc_id as external_id,
        case when {_list(PHRASES)}[(doc_id % {len(PHRASES)} + 1)::int] = '' then text else coalesce(text || ' ', '') || {_list(PHRASES)}[(doc_id % {len(PHRASES)} + 1)::int] end as content,
        case when doc_id % 11 = 0 then '' else {_list(CITIES)}[(doc_id % {len(CITIES)} + 1)::int] end as location, lang as language,
        timestamp '{AS_OF}' - to_minutes((doc_id * 7) % 43200) as collected_at, doc_id % 4 as job_id
    from documents
), sources as (
    select distinct source as source_name, 'Source ' || substr(source, 4)::int as display_name, {_list(model.SOURCE_TYPES)}[substr(source, 4)::int % 4 + 1] as source_type,
        {_list(model.CATEGORIES)}[substr(source, 4)::int % {len(model.CATEGORIES)} + 1] as category, substr(source, 4)::int % 9 <> 4 as active
    from documents
), tokenized as (
    select *, lower(content) as low, case when bare = '' then [] else string_split_regex(bare, '[ \\t\\n\\r]+') end as toks,
        case when trim(content, E' \\t\\n\\r') = '' then 0 else len(string_split_regex(trim(content, E' \\t\\n\\r'), '\\s+')) end as words
    from (select *, trim(translate(lower(content), '{PUNCTUATION}', ''), E' \\t\\n\\r') as bare from posts)
), valued as (
    select *, ({_VALENCE})::bigint as score, len(toks)::bigint as token_count from tokenized
), sentiment as (
    select *, case when comparative > {model.POSITIVE_ABOVE} then 'positive' when comparative < {model.NEGATIVE_BELOW} then 'negative' else 'neutral' end as indicator
    from (select *, case when token_count = 0 then 0.0::double else score::double / token_count::double end as comparative from valued)
), relevance as (
    select *, least(len(matched_keywords)::double / {len(model.RELEVANCE_KEYWORDS)}, 1.0::double) as relevance, len(matched_keywords) > 0 as is_relevant
    from (select *, {_contained(model.RELEVANCE_KEYWORDS)} as matched_keywords from sentiment)
), dqi as (
    select *, (participation + justification + respectfulness + constructiveness + evidence) / 5 as dqi_total
    from (select *, case when words >= {model.WORDS_FULL} then 1.0::double when words >= {model.WORDS_PARTIAL} then 0.5::double else 0.0::double end as participation,
        case when j >= 2 then 1.0::double when j = 1 then 0.5::double else 0.0::double end as justification,
        case when words = 0 then 0.0::double else greatest(0.0::double, 1.0::double - 0.25::double * h) end as respectfulness,
        case when c >= 3 then 1.0::double when c >= 1 then 0.5::double else 0.0::double end as constructiveness,
        case when e >= 2 then 1.0::double when e = 1 then 0.5::double else 0.0::double end as evidence
        from (select *, len({_contained(model.JUSTIFICATION_MARKERS)}) as j, len({_contained(model.HOSTILE_MARKERS)}) as h, len({_contained(model.CONSTRUCTIVE_MARKERS)}) as c, len({_contained(model.EVIDENCE_MARKERS)}) as e from relevance))
), cities as (
    select location as city, count(*) filter (indicator = 'positive') as positive, count(*) filter (indicator = 'neutral') as neutral, count(*) filter (indicator = 'negative') as negative, count(*) as total
    from sentiment where location <> '' group by location
), city_sources as (
    select location as city, source_name, category, count(*) filter (indicator = 'positive') as positive, count(*) filter (indicator = 'neutral') as neutral, count(*) filter (indicator = 'negative') as negative, count(*) as total
    from sentiment where location <> '' group by all
), places as (
    select * from (values {", ".join("('" + c + f"', {lat}::double, {lng}::double)" for c, (lat, lng) in model.CITY_COORDINATES.items())}) t(city, lat, lng)
)"""
