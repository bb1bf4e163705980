"""Programme areas: the benchmark's words and pairs of words as the vocabulary, all documents as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vocabulary as op
from ..registry import query
from .carriers import read


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(area, term, place): words of eight letters or more, and words with the one after them, of nine areas."""
    words = read(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("([A-Za-z]{8,})"), F.lit(1)).alias("one"), F.regexp_extract_all("text", F.lit("([A-Za-z]+ [a-z]{4,})"), F.lit(1)).alias("two"))
    area = F.concat(F.lit("WCH - Area "), F.col("item_id") * 7 % 9)
    return words.select(area.alias("area"), F.explode(F.concat("one", "two")).alias("term"), (-F.col("item_id")).alias("place"))


_SQL = r"""v AS (SELECT item_id, unnest(list_concat(regexp_extract_all(text, '[A-Za-z]{8,}'), regexp_extract_all(text, '[A-Za-z]+ [a-z]{4,}'))) AS term FROM benchmark),
 t AS (SELECT DISTINCT concat('WCH - Area ', item_id * 7 % 9) AS area, lower(term) AS low FROM v), o AS (SELECT concat('WCH - Area ', item_id * 7 % 9) AS area, min(-item_id) AS place FROM v GROUP BY 1),
 w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS low FROM documents),
 p AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS x, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), 1) AS i FROM documents),
 b AS (SELECT DISTINCT doc_id, x || gap || next AS low FROM (SELECT doc_id, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS gap, lead(x, 2) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM p) WHERE gap = ' '),
 h AS (SELECT DISTINCT doc_id, area FROM (SELECT * FROM w UNION ALL SELECT * FROM b) JOIN t USING (low)),
 a AS (SELECT d.doc_id, coalesce(string_agg(h.area, '; ' ORDER BY o.place, h.area), 'Unspecified Program Area') AS areas FROM documents d LEFT JOIN h USING (doc_id) LEFT JOIN o ON o.area = h.area GROUP BY d.doc_id)"""


@query(f"WITH {_SQL} SELECT doc_id, areas FROM a")
def programme_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every area of every document, in the vocabulary's order."""
    found = op.areas(read(spark, sf_dir, "documents"), "doc_id", "text", terms(spark, sf_dir))
    return found.select("doc_id", F.array_join("areas", "; ").alias("areas"))


@query(f"WITH {_SQL} SELECT replace(x, 'WCH - ', '') AS area, count(*) AS rows FROM (SELECT unnest(string_split(areas, '; ')) AS x FROM a) GROUP BY 1")
def programme_area_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.area_counts(op.areas(read(spark, sf_dir, "documents"), "doc_id", "text", terms(spark, sf_dir)))
