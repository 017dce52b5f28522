"""SQL of those queries that SQL can express."""

_STAND_INS = "('', 'n/a', 'na', 'none', 'null', 'nil', 'unknown', 'unk', 'tbd', '-', '--', '?', 'nan', 'missing', 'not available', 'not applicable', 'not reported')"


def _filled(x: str) -> str:
    return f"CASE WHEN lower(trim(CAST({x} AS VARCHAR))) NOT IN {_STAND_INS} THEN trim(CAST({x} AS VARCHAR)) END"


def _date(x: str) -> str:
    x = f"trim({x})"
    return (
        f"CASE WHEN regexp_matches({x}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(substr({x}, 1, 10) AS DATE) "
        f"WHEN regexp_full_match({x}, '\\d{{8}}') THEN CAST(try_strptime({x}, '%Y%m%d') AS DATE) "
        f"WHEN regexp_full_match({x}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(try_strptime({x}, '%m/%d/%Y') AS DATE) "
        f"WHEN regexp_full_match({x}, '[A-Za-z]{{3}} \\d{{1,2}}, \\d{{4}}') THEN CAST(try_strptime({x}, '%b %d, %Y') AS DATE) END"
    )


def _concept(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({x})), '^(us-gaap|ifrs-full|ifrs|gaap|dei|srt)\\s*[:_]\\s*', ''), '[^a-z0-9]+', '', 'g')"


_P6 = f"""
WITH names AS (SELECT {_concept('concept')} AS c, min(metric) AS metric FROM concept_map GROUP BY 1),
keyed AS (
  SELECT f.*, coalesce('metric ' || metric, 'concept ' || {_concept('f.concept')}) AS k_metric, regexp_replace(upper(trim(unit)), '^.*:', '') AS k_unit,
    {_date('period_end')} AS k_end, upper(trim(fp)) AS k_fp, {_date('filed')} AS day, nullif(ltrim(regexp_replace({_filled('accn')}, '[^0-9]', '', 'g'), '0'), '') AS code
  FROM xbrl_facts f LEFT JOIN names ON {_concept('f.concept')} = names.c WHERE fact_id IS NOT NULL),
grouped AS (SELECT *, min(fact_id) OVER g AS group_id, max(fact_id) OVER g AS last_id FROM keyed WINDOW g AS (PARTITION BY cik, k_metric, k_unit, k_end, k_fp)),
cells AS (
  SELECT group_id, fact_id, day, code, unnest(['concept', 'period_start', 'val', 'accn', 'frame']) AS field_name,
    unnest([{_filled('concept')}, {_filled('period_start')}, {_filled('val')}, {_filled('accn')}, {_filled('frame')}]) AS value
  FROM grouped WHERE group_id < last_id),
top AS (SELECT group_id, field_name, fact_id, value FROM cells WHERE value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY day DESC NULLS LAST, lpad(code, 40, '0') DESC NULLS LAST, fact_id) = 1)
"""
_FIELD = "max(value) FILTER (field_name = '{0}')"

SQL: dict[str, str] = {
    "p6_found": f"{_P6} SELECT group_id, field_name, fact_id FROM top",
    "p6_survivors": f"{_P6} SELECT group_id, {', '.join(f'{_FIELD.format(f)} AS {f}' for f in ('concept', 'period_start', 'accn', 'frame'))}, {_FIELD.format('val')}::DOUBLE AS val FROM top GROUP BY 1",
}
