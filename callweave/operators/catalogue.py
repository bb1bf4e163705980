"""Catalogue work: flags, name resolution, summaries, rows from candidates, re-scoring and tenants."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import funder_initials, funder_letters


def flagged(rows: DataFrame, known: DataFrame, key: str, name: str = "in_catalogue") -> DataFrame:
    """rows with whether their key is in the catalogue; null keys are not."""
    keys = known.select(F.col(key).alias("__key")).where("__key is not null").distinct().withColumn("__in", F.lit(True))
    return rows.join(keys, F.col(key) == F.col("__key"), "left").withColumn(name, F.coalesce("__in", F.lit(False))).drop("__key", "__in")


def named_tenants(pieces: DataFrame, tenants: DataFrame) -> DataFrame:
    """pieces: (piece), tenants: (tenant, name). (piece, rank, tenant, how) of all tenants that a piece may name.

    Equal names, then acronyms, then containment from four characters, which meets on the shorter name's first four.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    p = pieces.select("piece").distinct().withColumns({"n": norm(F.col("piece")), "letters": funder_letters(F.col("piece")), "initials": funder_initials(F.col("piece"))}).where("n <> ''")
    t = tenants.select("tenant", norm(F.col("name")).alias("tn"), funder_letters(F.col("name")).alias("tl"), funder_initials(F.col("name")).alias("ti")).where("tn <> ''")
    found = lambda df, rank, how: df.select("piece", F.lit(rank).alias("rank"), "tenant", F.lit(how).alias("how"))
    equal = found(p.join(t, F.col("n") == F.col("tn")), 1, "name")
    short = found(p.where(F.length("letters").between(2, 6)).join(t, F.col("letters") == F.col("ti")), 2, "acronym").union(found(p.join(t.where(F.length("tl").between(2, 6)), F.col("initials") == F.col("tl")), 2, "acronym"))
    runs = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 3), lambda i: F.substr(F.col(c), i, F.lit(4)))))
    long_p, long_t = p.where(F.length("n") >= 4), t.where(F.length("tn") >= 4)
    within = found(long_p.withColumn("run", F.left("n", F.lit(4))).join(long_t.withColumn("run", runs("tn")), "run").where(F.contains("tn", "n")), 3, "part")
    holds = found(long_t.withColumn("run", F.left("tn", F.lit(4))).join(long_p.withColumn("run", runs("n")), "run").where(F.contains("n", "tn")), 3, "part")
    return equal.union(short).union(within).union(holds)


def resolved_names(pieces: DataFrame, tenants: DataFrame) -> DataFrame:
    """pieces: (id, piece), tenants: (tenant, name). (id, piece, tenant, how) of the first tenant that a piece names; distinct pieces are resolved once."""
    best = named_tenants(pieces, tenants).groupBy("piece").agg(F.min(F.struct("rank", "tenant", "how")).alias("m"))
    return pieces.join(best, "piece").select("id", "piece", F.col("m.tenant").alias("tenant"), F.col("m.how").alias("how"))


def role_mix(rows: DataFrame, role: str) -> DataFrame:
    """(role, n, share): counts over one denominator, all rows."""
    per = rows.groupBy(F.coalesce(F.nullif(F.trim(role), F.lit("")), F.lit("Unassigned")).alias("role")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))  # one row
    return per.crossJoin(F.broadcast(total)).select("role", "n", F.bround(100 * F.col("n") / F.col("total"), 1).alias("share"))


def owner_summary(rows: DataFrame, group: str, owner: str) -> DataFrame:
    """(group, owners): 'Ann (3), Bob (1)' by first names, most first, then by name. Counted before anything is listed."""
    first = F.split_part(F.trim(owner), F.lit(" "), F.lit(1))
    per = rows.where(F.trim(F.coalesce(owner, F.lit(""))) != "").groupBy(group, first.alias("name")).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "name")))
    return per.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: F.concat(x["name"], F.lit(" ("), (-x["less"]).cast("string"), F.lit(")"))), ", ").alias("owners"))


def reason_counts(rows: DataFrame, reason: str, width: int = 48) -> DataFrame:
    return rows.where(F.trim(F.coalesce(reason, F.lit(""))) != "").groupBy(F.left(F.trim(reason), F.lit(width)).alias("reason")).agg(F.count("*").alias("n"))


def ingest_order(rows: DataFrame, classes: Sequence[str], kind: str, size: str, at: str) -> DataFrame:
    """rows with their place: by class rank (unknown last), larger first, then as they came. One row a source, so one sort places them."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, classes)), F.col(kind)), F.lit(0)), F.lit(len(classes) + 1))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(rank, F.desc(size), at)))


def unique_slugs(rows: DataFrame, key: str, slug: str) -> DataFrame:
    """Slugs with -2, -3, ... for those taken before, by key."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(key))
    return rows.withColumn(slug, F.when(n > 1, F.concat(F.col(slug), F.lit("-"), n.cast("string"))).otherwise(F.col(slug)))


def keyed_object(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, object): JSON of key to value, sorted by key; the keys of a group are its settings, so few."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))
    return rows.groupBy(group).agg(F.to_json(F.map_from_entries(entries)).alias("object"))


def built_rows(candidates: DataFrame, fields: Mapping[str, Column], required: Sequence[str]) -> DataFrame:
    """Rows of a target schema from candidates: each field by its column, blanks as null; rows that lack a required field go."""
    blank = lambda c: F.when(F.trim(c.cast("string")) != "", c)
    made = candidates.select(*[blank(c).alias(k) for k, c in fields.items()])
    return made.dropna(subset=list(required))


def rescored(rows: DataFrame, key: str, stored: Sequence[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, old, new) structs of the stored fields where scoring anew differs; nulls compare equal."""
    new = score(rows).select(key, F.struct(*stored).alias("new"))
    old = rows.select(key, F.struct(*stored).alias("old"))
    return old.join(new, key).where(~F.col("old").eqNullSafe(F.col("new")))


def for_each_tenant(rows: DataFrame, tenants: DataFrame, screen: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Screens all rows for each active tenant: tenants are a small dimension, met with every row in the scan; no shuffle."""
    active = tenants.where("active").drop("active")
    return screen(rows.crossJoin(active))


def resolved_sources(hits: DataFrame, id_: str, title: str, url: str, aggregators: Sequence[str]) -> DataFrame:
    """hits: (id, title, url). (id, best): the primary address whose path shares most of the title's words, then the shortest, then by name."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^https?://(?:www\.)?([^/?#]+)", 1)
    other = F.lit(False)
    for a in aggregators:
        other = other | (host == a) | host.endswith(f".{a}")
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}]+")), lambda w: F.length(w) >= 4)
    score = F.size(F.array_intersect(words(F.col(title)), words(F.col(url))))
    return hits.where(~other & (host != "")).groupBy(id_).agg(F.min(F.struct((-score).alias("less"), F.length(url).alias("n"), F.col(url).alias("url"))).alias("m")).select(id_, F.col("m.url").alias("best"), (-F.col("m.less")).alias("shared"))
