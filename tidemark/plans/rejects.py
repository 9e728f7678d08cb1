"""Queries over the core operators for rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.rejects import load_lines


def _loaded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.parquet(f"{folder}/raw_reports.parquet")
    members = spark.read.parquet(f"{folder}/dataset_domains.parquet").select("dataset")
    return load_lines(lines, members)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _loaded(spark, folder)[1].select("line_id", "reason")


def p5_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The valid lines with typed counts and times."""
    clean = _loaded(spark, folder)[0]
    counts = ("run_id", "images_converted", "images_skipped", "boxes_written", "boxes_degenerate")
    return clean.withColumns({c: clean[c].cast("int") for c in counts} | {"finished_at": clean["finished_at"].cast("timestamp_ntz")})


_VALUE = r"""regexp_replace(CASE WHEN f LIKE '"%' THEN replace(f[2:len(f) - 1], '""', '"') ELSE f END, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')"""
_COUNT = r"""(regexp_full_match({0}, '[0-9]+') AND coalesce(try_cast({0} AS HUGEINT), 2147483648) <= 2147483647)"""
_TIME = r"""(regexp_full_match(v[2], '[0-9]{4}-[0-9]{2}-[0-9]{2} ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') AND try_cast(v[2][1:10] AS DATE) IS NOT NULL)"""

_PARSED = rf"""
WITH l AS (SELECT DISTINCT line_id, coalesce(raw_line, '') AS line FROM raw_reports),
s AS (SELECT line_id, string_split(line, '"') AS p FROM l),
q AS (SELECT line_id, len(p) % 2 = 1 AND len(list_filter(list_transform(range(1, len(p) + 1), lambda i: i % 2 = 0 OR (p[i] = '' AND i > 1 AND i < len(p))
    OR ((i = 1 OR p[i] LIKE ',%' OR (i = len(p) AND p[i] = '')) AND (i = len(p) OR p[i] LIKE '%,' OR (i = 1 AND p[i] = '')))), lambda x: NOT x)) = 0 AS quoted,
  string_split(array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i % 2 = 1 THEN replace(p[i], ',', chr(1)) ELSE p[i] END), '"'), chr(1)) AS cells FROM s),
c AS (SELECT line_id, quoted, len(cells) AS n, list_transform(cells, lambda f: {_VALUE}) AS v FROM q),
j AS (SELECT line_id, v, CASE WHEN NOT quoted THEN 'quoting' WHEN n <> 9 THEN 'columns'
  WHEN {_COUNT.format('v[1]')} AND {_TIME} AND v[3] IN (SELECT dataset FROM dataset_domains)
   AND {' AND '.join(f"(v[{k}] = '' OR {_COUNT.format(f'v[{k}]')})" for k in (4, 5, 6, 7))} THEN NULL ELSE 'value' END AS reason FROM c)"""

P5_FOUND = f"{_PARSED} SELECT line_id, reason FROM j WHERE reason IS NOT NULL"
P5_LOADED = f"""{_PARSED} SELECT line_id, v[1]::INT AS run_id, v[2]::TIMESTAMP AS finished_at, v[3] AS dataset,
  try_cast(v[4] AS INT) AS images_converted, try_cast(v[5] AS INT) AS images_skipped, try_cast(v[6] AS INT) AS boxes_written,
  try_cast(v[7] AS INT) AS boxes_degenerate, nullif(v[8], '') AS skipped_files, nullif(v[9], '') AS errors FROM j WHERE reason IS NULL"""


def queries() -> dict:
    return {"p5_found": p5_found, "p5_loaded": p5_loaded}


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_FOUND, "p5_loaded": P5_LOADED}
