"""Duplicates over the carriers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import dedup as op
from ..registry import query
from .carriers import calls, read, with_calls


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY md5(text)) AS first, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents QUALIFY copies > 1")
def exact_dups_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_seen(read(spark, sf_dir, "documents"), F.md5("text"), "doc_id")


_ROWS = "SELECT uid AS id, CASE WHEN uid % 10 = 0 AND uid % 700 >= 10 THEN 'ID' || (uid % 700) ELSE '' END AS oid, CASE WHEN uid % 6 = 0 THEN 'x.org/' || (uid % 900) ELSE '' END AS link, funder, deadline, cents // 5000000 AS value, CASE WHEN uid % 4 = 0 THEN country END AS country FROM calls"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = calls(spark, sf_dir), F.col("uid")
    return c.select(
        k.alias("id"),
        text.opportunity_id(F.when(k % 10 == 0, F.concat(F.lit("ID"), (k % 700).cast("string")))).alias("oid"),
        F.when(k % 6 == 0, urls.comparable(F.concat(F.lit("https://www.X.org/"), (k % 900).cast("string"), F.lit("/?a=1")))).otherwise("").alias("link"),
        "funder", "deadline", F.floor(F.col("cents") / 5_000_000).alias("value"), F.when(k % 4 == 0, F.array("country")).otherwise(F.array().cast("array<string>")).alias("countries"),
    )


# an equal id or link outranks the country; only rule 5 is vetoed by it, and by two ids under one link
@query(with_calls(f""", r AS ({_ROWS}), m AS (
 SELECT a.id, b.id AS lead, '1 id' AS rule FROM r a JOIN r b ON a.oid = b.oid AND a.oid <> '' AND b.id < a.id
 UNION ALL SELECT a.id, b.id, '2 link' FROM r a JOIN r b ON a.link = b.link AND a.link <> '' AND b.id < a.id AND (a.oid = '' OR b.oid = '' OR a.oid = b.oid)
 UNION ALL SELECT a.id, b.id, '5 value' FROM r a JOIN r b ON a.funder = b.funder AND a.deadline = b.deadline AND a.value = b.value AND b.id < a.id AND coalesce(a.country, b.country, '') = coalesce(b.country, a.country, '') AND NOT (a.link = b.link AND a.link <> '' AND a.oid <> '' AND b.oid <> '' AND a.oid <> b.oid))
 SELECT id, arg_min(lead, rule || printf('%012d', lead)) AS lead, min(rule) AS rule FROM m GROUP BY id"""))
def dedup_rules_1_2_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return op.first_rule([op.same_id(rows), op.same_link(rows), op.same_value(rows, op.funder_pairs(rows))])


_NAMES = """n AS (SELECT n_name AS name FROM nation UNION SELECT n_name || ' Science and Development Fund' FROM nation UNION SELECT left(n_name, 1) || 'SDF' FROM nation
 UNION SELECT left(n_name, 1) || 'SDF - ' || n_name || ' Science & Development Fund' FROM nation UNION SELECT upper(p_type) FROM part UNION SELECT string_agg(left(w, 1), '.') FROM (SELECT p_type, unnest(string_split(p_type, ' ')) AS w FROM (SELECT DISTINCT p_type FROM part)) GROUP BY p_type)"""
_AFTER = "CASE WHEN instr(name, ' - ') > 0 THEN substr(name, instr(name, ' - ') + 3) ELSE name END"


@query(f"""WITH {_NAMES}, c AS (SELECT name, trim(regexp_replace(lower({_AFTER}), '[^a-z0-9]+', ' ', 'g')) AS core, upper(regexp_replace(name, '[^A-Za-z]', '', 'g')) AS letters,
  upper(coalesce(array_to_string(list_transform(list_filter(regexp_extract_all({_AFTER}, '[A-Za-z][A-Za-z''&\\-]*'), lambda w: lower(w) NOT IN ({", ".join(f"'{w}'" for w in text.SMALL_WORDS)})), lambda w: left(w, 1)), ''), '')) AS initials FROM n)
 SELECT a.name AS a, b.name AS b FROM c a, c b WHERE a.core <> '' AND b.core <> '' AND (a.core = b.core OR (length(a.core) >= 5 AND length(b.core) >= 5 AND (contains(a.core, b.core) OR contains(b.core, a.core)))
  OR (length(a.letters) BETWEEN 2 AND 6 AND a.letters = b.initials) OR (length(b.letters) BETWEEN 2 AND 6 AND b.letters = a.initials))""")
def funder_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names stand for one funder: nations' funds with their acronyms and prefixes, and trades with their initials."""
    n, kinds = read(spark, sf_dir, "nation").select("n_name"), read(spark, sf_dir, "part").select("p_type").distinct()
    short = F.concat(F.left("n_name", F.lit(1)), F.lit("SDF"))
    parts = [
        n.select(F.col("n_name").alias("funder")), n.select(F.concat("n_name", F.lit(" Science and Development Fund"))), n.select(short),
        n.select(F.concat(short, F.lit(" - "), F.col("n_name"), F.lit(" Science & Development Fund"))), kinds.select(F.upper("p_type")),
        kinds.select(F.array_join(F.transform(F.split("p_type", " "), lambda w: F.left(w, F.lit(1))), ".")),
    ]
    names = parts[0]
    for p in parts[1:]:
        names = names.union(p)
    return op.funder_pairs(names)


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title) of the pages, each normalised title once with its least id."""
    title = text.normal_title(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), title.alias("title")).groupBy("title").agg(F.min("id").alias("id")).where("title <> ''")


@query()
def dedup_rule_3_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct titles with a sequence ratio of at least 0.90."""
    return op.similar_titles(page_titles(spark, sf_dir)).select("id", "other", F.round("ratio", 6).alias("ratio"))


@query()
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = page_titles(spark, sf_dir)
    return op.leaders(titles.select("id", F.col("id").alias("rank")), op.similar_titles(titles).select("id", "other"))


def titled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with titles of parts' names: siblings differ in a year or a country, and funders come under several names."""
    k, p = F.col("id"), read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name")
    rows = _rows(spark, sf_dir).withColumn("part", k % 400 + 1).join(p, "part")
    title = F.concat(F.lit("Call for proposals: "), F.col("p_name"), F.when(k % 5 == 0, F.lit(" 2026")).when(k % 5 == 1, F.lit(" now open")).otherwise(F.lit("")))
    funder = F.when(k % 2 == 0, F.lit("Global Science and Health Fund")).when(k % 7 == 0, F.lit("GSHF")).otherwise(F.col("funder"))
    return rows.select("id", "oid", "link", text.normal_title(title).alias("title"), funder.alias("funder"), "deadline", "value", "countries")


@query()
def dedup_rules_1_to_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain. The ratio is beyond SQL; the tests hold it against a plain search."""
    return op.find_duplicates(titled_calls(spark, sf_dir))
