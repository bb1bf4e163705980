"""Duplicate calls: the rule chain, similar titles by an exact filter, funders that are the same, and greedy leaders."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distinctive_tokens, funder_core, funder_initials, funder_letters, sequence_ratio
from ..sources.tables import ensure_checkpoints

RATIO = 0.90
#: Which rows rules 4 and 5 take.
_DATED = "funder is not null and deadline is not null"


def first_seen(df: DataFrame, key: Column, id_: str) -> DataFrame:
    """(id, first, copies) of rows that share a key: hashes are grouped with map-side minima, and joined back slim."""
    keyed = df.select(F.col(id_).alias("id"), key.alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return keyed.join(firsts, "key").select("id", "first", "copies")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all shuffle partitions: slim rows that multiply in a join would else be taken for the work of one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def first_rule(found: list[DataFrame]) -> DataFrame:
    """(id, lead, rule) of the first rule that finds a lead, and its least lead."""
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.groupBy("id").agg(F.min(F.struct("rule", "lead")).alias("m")).select("id", F.col("m.lead").alias("lead"), F.col("m.rule").alias("rule"))


def _among(rows: DataFrame, among: DataFrame | None, earlier: bool = False) -> tuple[DataFrame, Column]:
    """Where leads are sought, and what a lead must be: any of these, or an earlier one, as always among the rows themselves."""
    return (rows if among is None else among, F.col("lead") < F.col("id") if among is None or earlier else F.col("lead").isNotNull())


def same_id(rows: DataFrame, among: DataFrame | None = None, earlier: bool = False) -> DataFrame:
    """Rule 1 over (id, oid): the least id with the same opportunity id leads."""
    there, lead = _among(rows, among, earlier)
    firsts = there.where("oid <> ''").groupBy("oid").agg(F.min("id").alias("lead"))
    return rows.where("oid <> ''").select("id", "oid").join(firsts, "oid").where(lead).select("id", "lead", F.lit("1 id").alias("rule"))


def same_link(rows: DataFrame, among: DataFrame | None = None, earlier: bool = False) -> DataFrame:
    """Rule 2 over (id, oid, link): the least id with the same link leads, unless both have opportunity ids and they differ.

    A row without an id may follow any row of its link; one with an id follows those without and those with its own:
    three minima for each link, no pairs.
    """
    there, ok = _among(rows, among, earlier)
    keyed, there = (x.where("link <> ''").select("id", "oid", "link") for x in (rows, there))
    per = there.groupBy("link").agg(F.min("id").alias("any"), F.min(F.when(F.col("oid") == "", F.col("id"))).alias("bare"))
    own = there.groupBy("link", "oid").agg(F.min("id").alias("own"))
    both = keyed.join(per, "link").join(own, ["link", "oid"], "left")
    lead = F.when(F.col("oid") == "", F.col("any")).otherwise(F.least("bare", "own"))
    return both.select("id", lead.alias("lead"), F.lit("2 link").alias("rule")).where(ok)


def _mark() -> Column:
    """The link of a row that has an opportunity id as well: rows of one mark and other ids are not the same call."""
    return F.when((F.col("link") != "") & (F.col("oid") != ""), F.col("link"))


def _per_mark(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, _mark().alias("mark")).agg(F.min("id").alias("lead"))


def _least_marks(led: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, mark, lead) of a group's least lead without a mark and of its two or three marks with the least: what _choices needs."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("mark").isNotNull(), "lead"))
    return led.groupBy(*by, "mark").agg(F.min("lead").alias("lead")).withColumn("nth", place).where("nth <= 3").drop("nth")


def _choices(led: DataFrame, by: list[str]) -> DataFrame:
    """by and the least leads of a group: without a mark, of any mark, that mark, and of any other mark."""
    marks = F.array_sort(F.collect_list(F.when(F.col("mark").isNotNull(), F.struct("lead", "mark"))))  # three at most
    heads = _least_marks(led, by).groupBy(*by).agg(F.min(F.when(F.col("mark").isNull(), F.col("lead"))).alias("bare"), marks.alias("m"))
    first, second = F.get("m", F.lit(0)), F.get("m", F.lit(1))
    return heads.select(*by, "bare", first["lead"].alias("first"), first["mark"].alias("first_mark"), second["lead"].alias("second"))


def _allowed() -> Column:
    """The least of a group's leads that the row's link and id do not veto; equal ids are rule 1's."""
    return F.least("bare", F.when(_mark() == F.col("first_mark"), F.col("second")).otherwise(F.col("first"))).alias("lead")


def _named(countries: Column) -> Column:
    return F.transform(F.array_distinct(countries), lambda c: F.concat(F.lit("="), c))


def _stands_in(rows: DataFrame) -> DataFrame:
    """rows once for each place under which a lead is found: everywhere, and under its countries or under no country."""
    own = F.when(F.size("countries") == 0, F.array(F.lit("-"))).otherwise(_named(F.col("countries")))
    return rows.withColumn("place", F.explode(F.concat(F.array(F.lit("*")), own))).drop("countries")


def _asked_in(rows: DataFrame) -> DataFrame:
    """rows once for each place where a lead is sought, so that two titles that name countries and share none never meet."""
    places = F.when(F.size("countries") == 0, F.array(F.lit("*"))).otherwise(F.concat(F.array(F.lit("-")), _named(F.col("countries"))))
    return rows.withColumn("place", F.explode(places)).drop("countries")


def _led(asked: DataFrame, led: DataFrame, by: list[str], ok: Column, rule: str) -> DataFrame:
    """asked: (id, oid, link, countries, by), led: (by, place, mark, lead). (id, lead, rule) of the least allowed lead of equal keys."""
    keys = [*by, "place"]
    found = _asked_in(asked).join(_choices(led, keys), keys).select("id", _allowed()).where(ok)
    return found.groupBy("id").agg(F.min("lead").alias("lead")).withColumn("rule", F.lit(rule))


def _met(rows: DataFrame, there: DataFrame, funders: DataFrame, by: list[str], ok: Column) -> tuple[DataFrame, DataFrame]:
    """rows with the names b of their funder, and leads by b, of those groups only that hold a lead for a row: few funders share a day."""
    leads = there.withColumnRenamed("funder", "b")
    least = leads.groupBy(*by, "b").agg(F.min("id").alias("lead"))
    asked = rows.join(funders, F.col("funder") == F.col("a")).drop("a", "funder").join(least, [*by, "b"]).where(ok).drop("lead")
    return asked, leads.join(asked.select(*by, "b").distinct(), [*by, "b"], "left_semi")


def funder_pairs(names: DataFrame, name: str = "funder") -> DataFrame:
    """(a, b) of distinct names that stand for one funder, either way and with themselves.

    The cores are equal; or one holds the other, from five characters on; or one is an acronym of two to six letters
    and the other's initials. Containment is found by the shorter core's rarest run of five characters, which is one of
    the longer core's, so names meet few others, however alike they begin.
    """
    n = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    n = n.select("name", funder_core(F.col("name")).alias("core"), funder_letters(F.col("name")).alias("letters"), funder_initials(F.col("name")).alias("initials")).where("core <> ''")
    one, two = (n.select(*[F.col(c).alias(f"{c}_{k}") for c in n.columns]) for k in "ab")
    equal = one.join(two, F.col("core_a") == F.col("core_b"))
    runs = n.where(F.length("core") >= 5).withColumn("run", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("core") - 4), lambda i: F.substr(F.col("core"), i, F.lit(5))))))
    often = runs.groupBy("run").agg(F.count("*").alias("often"))
    rarest = runs.join(often, "run").groupBy("name", "core").agg(F.min(F.struct("often", "run")).alias("m")).select(F.col("name").alias("name_a"), F.col("core").alias("core_a"), F.col("m.run").alias("run"))
    within = rarest.join(runs.select(F.col("name").alias("name_b"), F.col("core").alias("core_b"), "run"), "run").where(F.contains("core_b", "core_a"))
    short = one.where(F.length("letters_a").between(2, 6)).join(two, F.col("letters_a") == F.col("initials_b"))
    pairs = equal.select("name_a", "name_b").union(within.select("name_a", "name_b")).union(short.select("name_a", "name_b"))
    return pairs.union(pairs.select("name_b", "name_a")).distinct().toDF("a", "b")


def same_value(rows: DataFrame, funders: DataFrame, among: DataFrame | None = None, earlier: bool = False) -> DataFrame:
    """Rule 5 over (id, oid, link, funder, deadline, value, countries): funder, deadline and value agree. Leads are kept by funder and place."""
    there, ok = _among(rows, among, earlier)
    dated = lambda x: x.where(f"{_DATED} and value is not null").select("id", "oid", "link", "funder", "deadline", "value", "countries")
    asked, leads = _met(dated(rows), dated(there), funders, ["deadline", "value"], ok)
    by = ["deadline", "value", "b"]
    return _led(asked, _per_mark(_stands_in(leads), [*by, "place"]), by, ok, "5 value")


def deadline_pairs(rows: DataFrame, among: DataFrame, funders: DataFrame, least: float = 0.75, shared: int = 3) -> DataFrame:
    """(title, title_b) of rows and of `among` that rule 4 takes for one call, if deadline and funder agree.

    Only titles of one deadline and equal funders meet, each two once, however many rows, countries and days they have;
    the ratio is computed once for them, where too few words are shared and the lengths leave room for it.
    """
    ensure_checkpoints(rows.sparkSession)
    kinds = lambda x: x.where(_DATED).select("title", "funder", "deadline").distinct()
    a = kinds(rows).join(funders, F.col("funder") == F.col("a")).select("title", "b", "deadline").distinct()
    b = kinds(among).toDF("title_b", "b", "deadline")
    met = _spread(a, "b", "deadline").join(_spread(b, "b", "deadline"), ["b", "deadline"]).select("title", "title_b").distinct().checkpoint()
    words = a.select("title").union(b.select("title_b")).distinct().withColumn("words", distinctive_tokens(F.col("title")))
    met = met.join(words, "title").join(words.toDF("title_b", "words_b"), "title_b").withColumn("common", F.size(F.array_intersect("words", "words_b")))
    n, m = F.length("title"), F.length("title_b")
    close = met.where(f"common < {shared}").where((F.least(n, m) >= (n + m) * (least / 2)) & (F.col("title") != "") & (F.col("title_b") != ""))
    alike = _spread(close, "title", "title_b").where((F.col("title") == F.col("title_b")) | (sequence_ratio(F.col("title"), F.col("title_b")) >= least))
    return met.where(f"common >= {shared}").select("title", "title_b").union(alike.select("title", "title_b"))


def same_deadline(rows: DataFrame, funders: DataFrame, pairs: DataFrame, among: DataFrame | None = None, earlier: bool = False) -> DataFrame:
    """Rule 4 over (id, oid, link, title, funder, deadline, countries): funder and deadline agree, and the titles have a ratio of 0.75 or three shared words.

    pairs: as deadline_pairs finds them, of these rows and leads or of more. Leads are found for each title of a day,
    funder and place, not for each row.
    """
    there, ok = _among(rows, among, earlier)
    dated = lambda x: x.where(_DATED).select("id", "oid", "link", "title", "funder", "deadline", "countries")
    asked, leads = _met(dated(rows), dated(there), funders, ["deadline"], ok)
    by = ["deadline", "b", "title", "place"]
    few = _least_marks(_per_mark(_stands_in(leads), by), by).withColumnRenamed("title", "title_b")
    return _led(asked, few.join(pairs, "title_b"), ["deadline", "b", "title"], ok, "4 deadline")


def title_pairs(rows: DataFrame, among: DataFrame | None = None, least: float = RATIO) -> DataFrame:
    """(title, title_b) of a row's title and another of `among`, or of the rows, that are equal or have the ratio."""
    asked = rows.where("title <> ''").select("title").distinct()
    if among is None:
        named = similar_titles(asked.select(F.col("title").alias("id"), "title"), least).select("id", "other")
        return named.union(named.select("other", "id")).union(asked.select("title", F.col("title").alias("other"))).toDF("title", "title_b")
    known = among.where("title <> ''").select("title").distinct()
    both = asked.withColumn("new", F.lit(True)).union(known.withColumn("new", F.lit(False))).groupBy("title").agg(F.max("new").alias("new"))
    named = similar_titles(both.select(F.col("title").alias("id"), "title", "new"), least, new="new").select("id", "other")
    return named.union(named.select("other", "id")).union(both.where("new").select("title", "title")).toDF("title", "title_b")


def same_title(rows: DataFrame, pairs: DataFrame, among: DataFrame | None = None, earlier: bool = False) -> DataFrame:
    """Rule 3 over (id, oid, link, title, countries): titles that are a pair, whose countries do not part them.

    pairs: as title_pairs finds them, of these rows and leads or of more.
    """
    there, ok = _among(rows, among, earlier)
    titled = lambda x: x.where("title <> ''").select("id", "oid", "link", "title", "countries")
    by = ["title", "place"]
    few = _least_marks(_per_mark(_stands_in(titled(there)), by), by).withColumnRenamed("title", "title_b")
    return _led(titled(rows), few.join(pairs, "title_b"), ["title"], ok, "3 title")


Pairs = tuple[DataFrame, DataFrame, DataFrame]


def pairs_of(rows: DataFrame, among: DataFrame | None = None, least: float = RATIO) -> Pairs:
    """Funders, titles and titles of a day that rules 3 to 5 take for the same: found once, however often the rules are asked."""
    ensure_checkpoints(rows.sparkSession)
    every = rows if among is None else rows.unionByName(among)
    funders = funder_pairs(every.select("funder")).checkpoint()
    return funders, title_pairs(rows, among, least).checkpoint(), deadline_pairs(rows, every if among is None else among, funders).checkpoint()


def find_duplicates(rows: DataFrame, least: float = RATIO, among: DataFrame | None = None, earlier: bool = False, pairs: Pairs | None = None) -> DataFrame:
    """rows: (id, oid, link, title, funder, deadline, value, countries); title normalised. (id, lead, rule).

    The first of the five rules by which an earlier row (a smaller id) is the same call, and the least such row; with
    `among`, of the same columns, any row of those, or any `earlier` one. Countries part titles under rules 3 to 5; an
    equal id or link outranks them. Two different ids under one link part rows under every rule.
    """
    if pairs is None:
        ensure_checkpoints(rows.sparkSession)
        rows = rows.checkpoint()  # read a dozen times
    funders, titles, days = pairs or pairs_of(rows, among, least)
    return first_rule([same_id(rows, among, earlier), same_link(rows, among, earlier), same_title(rows, titles, among, earlier), same_deadline(rows, funders, days, among, earlier), same_value(rows, funders, among, earlier)])


def kept_and_dropped(rows: DataFrame, known: DataFrame, least: float = RATIO, never: DataFrame | None = None) -> DataFrame:
    """(id, lead, rule) of all rows, each judged in the order of ids by known rows and by the rows that were kept before it.

    A row that is like a dropped one only is kept itself (lead null). A row that is like no known one, but like a row of
    `never`, goes with 'seen' before the rule. Rows are decided in rounds: those that no earlier open row is like are kept,
    and what is like a kept one goes; a group of copies takes two rounds, and rounds follow the longest chain of rows
    that are each like the one before. At the end the first rule and least lead of what went are read off all kept rows.
    """
    ensure_checkpoints(rows.sparkSession)
    every = rows.unionByName(known) if never is None else rows.unionByName(known).unionByName(never)
    pairs = pairs_of(rows, every, least)
    old = find_duplicates(rows, least, known, pairs=pairs).checkpoint()
    open_, seen = rows.join(old.select("id"), "id", "left_anti"), None
    if never is not None:
        seen = find_duplicates(open_, least, never, pairs=pairs).select("id", "lead", F.concat(F.lit("seen "), "rule").alias("rule")).checkpoint()
        open_ = open_.join(seen.select("id"), "id", "left_anti")
    open_, kept = open_.checkpoint(), rows.limit(0)
    while not open_.isEmpty():
        waits = find_duplicates(open_, least, pairs=pairs).select("id").checkpoint()
        new = open_.join(waits, "id", "left_anti").checkpoint()
        rest = open_.join(waits, "id", "left_semi")
        gone = find_duplicates(rest, least, new, True, pairs).select("id")
        kept, open_ = kept.union(new), rest.join(gone, "id", "left_anti").checkpoint()
    judged = rows.join(kept.select("id"), "id", "left_anti")
    if seen is not None:
        judged = judged.join(seen.select("id"), "id", "left_anti")
    out = first_rule([old, find_duplicates(judged, least, kept, True, pairs)])
    out = out.union(kept.select("id", F.lit(None).cast("long"), F.lit(None).cast("string")))
    return out if seen is None else out.union(seen)


#: Titles of a block of which all pairs are compared in one step, and cells of such a comparison held at a time.
BLOCK, CELLS = 8192, 1 << 18
#: Runs of q characters, and in how many bits those of a title are kept.
_MAPS = ((1, 256), (2, 256), (3, 512))


def _marks(title: str) -> bytes:
    """For each length of runs a map of bits: the k-th time that a run occurs turns the bit of (run, k)."""
    out = []
    for q, bits in _MAPS:
        times: dict[str, int] = {}
        turned = 0
        for run in (title[i : i + q] for i in range(len(title) - q + 1)):
            times[run] = k = times.get(run, 0) + 1
            turned ^= 1 << crc32(f"{k}{run}".encode("utf-8", "surrogatepass")) % bits
        out.append(turned.to_bytes(bits // 8, "little"))
    return b"".join(out)


def _mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([_marks(t) for t in batch], dtype=object)


def _near(cell: pd.DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of two rows of a cell, one a side, whose maps differ in no more bits than the ratio allows."""
    n, new = cell["n"].to_numpy(), cell["new"].to_numpy()
    words = np.frombuffer(b"".join(cell["map"]), np.uint64).reshape(len(cell), -1).T.copy()
    side = cell["side"].to_numpy()
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side != 0)  # -1: both
    one, two = [], []
    if len(left) and len(right):
        step = max(1, CELLS // len(right))
        top = n[right].max()
        for at in range(0, len(left), step):
            some, place = left[at : at + step], 0
            i = j = None
            for q, bits in _MAPS:
                most = (2 * q - 1) * (1 - least)
                part = words[place : place + bits // 64]
                place += bits // 64
                if i is None:  # all pairs, then those that are left
                    apart = np.zeros((len(some), len(right)), np.uint16)
                    for w in part:
                        apart += np.bitwise_count(w[some][:, None] ^ w[right][None, :])
                    x, y = np.nonzero(apart <= most * (n[some].max() + top) + 1e-9)
                    i, j, far = some[x], right[y], apart[x, y]
                else:
                    far = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in part)
                fits = far <= most * (n[i] + n[j]) + 1e-9
                i, j = i[fits], j[fits]
            ok = (new[i] | new[j]) & (np.abs(n[i] - n[j]) <= (1 - least) * (n[i] + n[j]) + 1e-9) & ((side[i] >= 0) | (i < j))
            one.append(i[ok])
            two.append(j[ok])
    return (np.concatenate(one), np.concatenate(two)) if one else (left[:0], left[:0])


def similar_titles(rows: DataFrame, least: float = RATIO, new: str | None = None) -> DataFrame:
    """rows: (id, title), titles of one id each. (id, other, ratio) of pairs with a ratio of at least `least`, id > other.

    With `new`, a flag of the rows, only pairs with a flagged row are sought.

    A ratio r leaves at most D = (1 - r) (m + n) of both titles' characters unmatched, each of which changes the counts of
    runs of q characters by 2 q - 1 in all. So maps of numbered runs differ in (2 q - 1) D bits at most, and only pairs
    that do are given to the ratio. Titles are dealt by length, a partner's being of the same band or of one next to it, and
    within a band to blocks of about BLOCK; a cell compares two blocks, CELLS pairs at a time. Nothing is lost.

    Short titles of one language share their frequent runs, so no key parts them: the pairs of a band are quadratic in
    number, but cost two instructions for each word of a map, and what moves is 200 bytes a title and block.
    """
    ensure_checkpoints(rows.sparkSession)
    n = F.length("title")
    band = F.floor(F.log(n.cast("double")) / (math.log(max(2 / least - 1, 1.01)) + 1e-9)).cast("int")
    told = rows.where("title <> ''").select("id", "title", n.alias("n"), (F.lit(True) if new is None else F.col(new)).alias("new"), band.alias("band"))
    known = _spread(told, "id").withColumn("map", F.pandas_udf(_mapped, "binary")("title")).checkpoint()
    blocks = lambda c: F.ceil(F.count_if(c) / BLOCK).cast("int")
    sizes = known.groupBy("band").agg(blocks(F.col("new")).alias("news"), blocks(~F.col("new")).alias("olds"))  # a row a band
    near = sizes.withColumn("step", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))).join(sizes.select((F.col("band")).alias("to"), F.col("news").alias("to_news"), F.col("olds").alias("to_olds")), F.col("band") + F.col("step") == F.col("to"))
    deal = F.xxhash64("id")
    mine = F.when(F.col("new"), F.pmod(deal, F.col("news"))).otherwise(F.col("news") + F.pmod(deal, F.col("olds"))).cast("int")
    others = F.when(F.col("new"), F.col("to_news") + F.col("to_olds")).otherwise(F.col("to_news"))  # known titles meet new ones only
    dealt = known.drop("title").join(F.broadcast(near), "band").withColumn("mine", mine).where(others > 0).withColumn("theirs", F.explode(F.sequence(F.lit(0), others - 1)))
    first = (F.col("step") > 0) | ((F.col("step") == 0) & (F.col("mine") < F.col("theirs")))
    side = F.when((F.col("step") == 0) & (F.col("mine") == F.col("theirs")), -1).when(first, 0).otherwise(1)
    cells = dealt.select("id", "n", "new", "map", side.alias("side"), F.least("band", "to").alias("low"), F.abs("step").alias("up"), F.when(first, F.col("mine")).otherwise(F.col("theirs")).alias("one"), F.when(first, F.col("theirs")).otherwise(F.col("mine")).alias("two"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        i, j = _near(cell, least)
        ids = cell["id"]
        return pd.DataFrame({"a": ids.iloc[i].to_numpy(), "b": ids.iloc[j].to_numpy()})

    kind, keys = dict(rows.dtypes)["id"], ["low", "up", "one", "two"]
    met = _spread(cells, *keys).groupBy(*keys).applyInPandas(compare, f"a {kind}, b {kind}")
    pairs = met.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("other"))
    title = known.select("id", "title")
    named = pairs.join(title.withColumnRenamed("title", "t"), "id").join(title.toDF("other", "u"), "other")
    named = _spread(named, "id", "other")
    return named.select("id", "other", F.when(F.col("t") == F.col("u"), F.lit(1.0)).otherwise(sequence_ratio(F.col("t"), F.col("u"))).alias("ratio")).where(F.col("ratio") >= least)


def leaders(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Greedy leaders: in the order of (rank, id) a row joins the first leader it is similar to, else it leads itself.

    ranked: (id, rank), pairs: (id, other) either way. A row leads if none of its earlier partners does. In a round those
    without an earlier open partner lead, and all later partners of these follow; only pairs of open rows are kept, so
    rounds shrink. Which leader is the first is asked once, at the end. Rounds follow the longest chain of partners that
    hangs on its order; no group of rows is gathered.
    """
    ensure_checkpoints(ranked.sparkSession)
    at = lambda c: F.struct(F.col(f"{c}.rank").alias("rank"), F.col(f"{c}.id").alias("id"))
    pairs = pairs.select("id", "other").checkpoint()  # read both ways
    either = pairs.union(pairs.select("other", "id")).toDF("i", "o")
    a, b = ranked.alias("a"), ranked.alias("b")
    edges = either.join(a, F.col("i") == F.col("a.id")).join(b, F.col("o") == F.col("b.id")).where(at("b") < at("a")).select(F.col("i").alias("id"), at("b").alias("before")).distinct().checkpoint()
    open_, lead = edges.select("id", F.col("before.id").alias("over")), None
    rows = open_.select("id").union(open_.select("over")).distinct()
    while not open_.isEmpty():
        new = rows.join(open_.select("id").distinct(), "id", "left_anti").checkpoint()
        gone = open_.join(new.withColumnRenamed("id", "over"), "over", "left_semi").select("id").distinct().checkpoint()
        lead = new if lead is None else lead.union(new)
        rows = rows.join(new.union(gone), "id", "left_anti").checkpoint()
        open_ = open_.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "over"), "over", "left_anti").select("id", "over").checkpoint()
    lead = rows if lead is None else lead.union(rows)
    first = edges.join(lead.select(F.col("id").alias("_l")), F.col("before.id") == F.col("_l"), "left_semi").groupBy("id").agg(F.min("before").alias("first"))
    return ranked.select("id").join(first, "id", "left").select("id", F.coalesce("first.id", "id").alias("lead"))


def blank_count(columns: Iterator[str]) -> Column:
    """How many of the fields are filled: the richer row leads."""
    total = F.lit(0)
    for c in columns:
        total = total + (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").cast("int")
    return total
