"""Gates, extraction from text, and derived criteria over the carriers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import deadlines, geo, places, taxonomy, text
from ..operators import gates as op
from ..operators import scoring, state
from ..registry import query
from .carriers import AS_OF, calls, read, spread, with_calls


@query(with_calls("SELECT uid, posted + 40 AS deadline, CASE uid % 3 WHEN 0 THEN 'labelled' WHEN 1 THEN 'labelled' ELSE 'unlabelled' END AS method FROM calls WHERE uid % 4 <> 3 UNION ALL SELECT uid, DATE '1998-12-31', 'rolling' FROM calls WHERE uid % 4 = 3"))
def deadline_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines read back from sentences made from the dates."""
    k, end = F.col("uid"), F.date_add("posted", 40)
    body = (
        F.when(k % 4 == 3, F.concat(F.lit("Posted "), F.date_format("posted", "d MMMM yyyy"), F.lit(". Applications are reviewed on a rolling basis.")))
        .when(k % 3 == 0, F.concat(F.lit("Published on "), F.date_format("posted", "yyyy-MM-dd"), F.lit(". Submission deadline: "), F.date_format(end, "d MMMM yyyy"), F.lit(", 17:00.")))
        .when(k % 3 == 1, F.concat(F.lit("Webinar "), F.date_format("posted", "MMM d, yyyy"), F.lit("; please apply by "), F.date_format(end, "MMMM d, yyyy"), F.lit(" at noon")))
        .otherwise(F.concat(F.lit("See also "), F.date_format(end, "yyyy-MM-dd"), F.lit(" for more")))
    )
    found = deadlines.deadline(body, 1998)
    return calls(spark, sf_dir).select("uid", found["deadline"].alias("deadline"), found["method"].alias("method"))


@query(with_calls("SELECT uid, posted FROM calls"))
def posted_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("uid")
    body = F.when(k % 2 == 0, F.concat(F.lit("Issued: "), F.date_format("posted", "d MMM yyyy"), F.lit(". Closing date 1 January 2030."))).otherwise(F.concat(F.lit("Call no. 5 \n"), F.date_format("posted", "dd/MM/yyyy"), F.lit("\nText follows; deadline 2029-02-03.")))
    return calls(spark, sf_dir).select("uid", deadlines.posted(body, "2020-01-01").alias("posted"))


_PLACE = "CASE s_suppkey % 5 WHEN 0 THEN 'strong' WHEN 1 THEN 'regional' WHEN 2 THEN 'foreign' WHEN 3 THEN 'silent' ELSE 'strong' END"


@query(f"SELECT s_suppkey, {_PLACE} AS fit, CASE s_suppkey % 5 WHEN 0 THEN 'Kenya|France' WHEN 1 THEN 'East Africa' WHEN 2 THEN 'United States|India' ELSE '' END AS places FROM supplier")
def geo_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    body = F.when(k == 0, "Partners in KENYA and France").when(k == 1, "for East Africa only").when(k == 2, "United States of America, India, Indiana").when(k == 3, "no place named").otherwise("open to any country")
    found = geo.places(body)
    return read(spark, sf_dir, "supplier").select("s_suppkey", geo.strength(found, body, ("Kenya",), ("East Africa",)).alias("fit"), F.array_join(found, "|").alias("places"))


@query("SELECT s_suppkey, CAST(CASE s_suppkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 END AS DOUBLE) AS score FROM supplier")
def geography_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    scope = F.when(k != 3, F.array(F.lit("East Africa"), F.lit("Mali"))).otherwise(F.array().cast("array<string>"))
    home = F.when(k == 0, "Kenya").otherwise("Chile")
    return read(spark, sf_dir, "supplier").select("s_suppkey", geo.presence(home, F.when(k == 1, F.array(F.lit("Mali"))).otherwise(F.array().cast("array<string>")), scope).alias("score"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'Request for proposals' WHEN doc_id % 6 = 1 THEN 'Concept note' WHEN doc_id % 6 = 2 THEN 'Notice of funding' ELSE 'Other' END AS kind, CASE WHEN doc_id % 6 = 1 THEN 'Sub' ELSE 'Prime' END AS role FROM documents""")
def solicitation_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    body = F.when(k == 0, "RFP and concept notes").when(k == 1, "Concept papers from a sub-recipient").when(k == 2, "NOFO 12").otherwise("nothing of the kind")
    return read(spark, sf_dir, "documents").select("doc_id", taxonomy.first_class(body, taxonomy.SOLICITATIONS, "Other").alias("kind"), taxonomy.applicant_role(body).alias("role"))


AREAS = {"Health": ("HIV", "malaria", "vaccin"), "Water": ("water", "WASH", "sanitation"), "Tin": ("TIN", "steel"), "Promo": ("promo",)}


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(p_type, '(?i)\\b(TIN\\b|STEEL\\b)') THEN 'Tin' END, CASE WHEN regexp_matches(p_type, '(?i)\\bpromo\\b') THEN 'Promo' END], lambda x: x IS NOT NULL), ',') AS areas FROM part""")
def programme_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(taxonomy.all_classes(F.col("p_type"), AREAS), ",").alias("areas"))


POLICY = op.Policy(countries=("Kenya",), broad=("East Africa",), themes=("health", "water", "clinic"), excluded=("mining",), infeasible=("aircraft",), aggregators=("agg.org",), blacklist=("spamgrants",))
_GATE = """CASE uid % 12 WHEN 0 THEN 'source: blacklisted' WHEN 1 THEN 'shape: search results' WHEN 2 THEN 'shape: listing' WHEN 3 THEN 'source: not primary' WHEN 4 THEN 'signal: none' WHEN 5 THEN 'type: individual award'
 WHEN 6 THEN 'geography: foreign' WHEN 7 THEN 'theme: excluded' WHEN 8 THEN 'theme: off' WHEN 9 THEN CASE WHEN deadline >= DATE '1998-07-01' THEN NULL ELSE 'closed: wording' END"""


@query(with_calls(f"SELECT uid, {_GATE} ELSE CASE WHEN deadline < DATE '{AS_OF}' THEN 'deadline: passed' WHEN deadline IS NULL AND posted < DATE '{AS_OF}' - 90 THEN 'deadline: stale' END END AS reason FROM calls").replace("'closed: wording' END", "'closed: wording' END"))
def gate_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full chain over calls composed so that each of its groups rejects some."""
    k = F.col("uid") % 12
    good = "We invite proposals; eligibility and how to apply below. Health and water clinics in Kenya."
    title = F.when(k == 2, "Current calls").when(k == 5, "Fellowships: call for proposals").when(k == 7, "Call for proposals: mining water").otherwise("Call for proposals 12")
    title = F.when(k == 4, "A pleasant afternoon by the lake").otherwise(title)
    body = F.when(k == 4, "It was sunny and nothing else happened to anyone there.").when(k == 6, "Grants: eligible applicants in Chile do not count; health water clinic in France. How to apply").when(k == 8, "Funding for poetry. How to apply in Kenya.").when(k == 9, good + " This call is now closed.").otherwise(good)
    url = F.when(k == 0, "https://spamgrants.com/1").when(k == 1, "https://a.org/s?q=x").when(k == 3, "https://www.agg.org/call/1").otherwise("https://a.org/call/1")
    rows = calls(spark, sf_dir)
    return rows.select("uid", op.gate(title, body, url, F.col("deadline"), F.col("posted"), POLICY, AS_OF).alias("reason"))


@query("""SELECT p_partkey, CASE WHEN a = 0 OR b = 0 THEN 'Decline' WHEN a = 1 AND b = 1 AND c = 1 THEN 'Proceed' ELSE 'Park' END AS verdict, CASE WHEN a = 0 OR b = 0 OR c = 0 THEN 'Not met' WHEN a = 0.5 OR c = 0.5 THEN 'Partial' ELSE 'Met' END AS compliance,
 CASE WHEN 1.5 * a - 0.5 * b + c - 1 >= 1 THEN 'Strong' WHEN 1.5 * a - 0.5 * b + c - 1 <= -0.5 THEN 'Weak' ELSE 'Moderate' END AS strength FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS a, CASE p_size % 5 WHEN 0 THEN 0.0 ELSE 1.0 END AS b, CASE p_size % 2 WHEN 0 THEN 1.0 ELSE 0.5 END AS c FROM part)""")
def decision_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey") % 3, F.col("p_size")
    a = F.when(k == 0, 1.0).when(k == 1, 0.5).otherwise(0.0)
    b, c = F.when(s % 5 == 0, 0.0).otherwise(1.0), F.when(s % 2 == 0, 1.0).otherwise(0.5)
    return read(spark, sf_dir, "part").select("p_partkey", scoring.decision_tree([a, b], [c]).alias("verdict"), scoring.compliance([a, b, c]).alias("compliance"), scoring.competitiveness([1.5 * a, -0.5 * b, c, F.lit(-1.0), F.lit(None).cast("double")]).alias("strength"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE greatest(least(b1, t1), least(b2, t2)) END AS DOUBLE) AS fit FROM (SELECT p_partkey, CASE WHEN p_size % 6 >= 4 THEN 1.0 WHEN p_size % 6 >= 2 THEN 0.5 ELSE 0.0 END AS b1, CASE WHEN p_partkey % 6 >= 4 THEN 1.0 WHEN p_partkey % 6 >= 2 THEN 0.5 ELSE 0.0 END AS t1, 0.0 AS b2, 1.0 AS t2 FROM part)""")
def strategic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = F.create_map(F.lit("health"), (F.col("p_size") % 6).cast("int"))
    theirs = F.when(F.col("p_partkey") % 7 == 0, F.create_map().cast("map<string,int>")).otherwise(F.create_map(F.lit("health"), (F.col("p_partkey") % 6).cast("int"), F.lit("water"), F.lit(5)))
    return read(spark, sf_dir, "part").select("p_partkey", scoring.strategic_fit(ours, theirs).alias("fit"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'call' WHEN 1 THEN NULL ELSE 'donor' END AS value, CASE WHEN s_suppkey % 2 = 0 THEN 'a=9,b=2,c=7' ELSE 'a=1,b=2' END AS settings FROM supplier")
def precedence_and_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    said = F.when(k % 3 == 0, "call").when(k % 3 == 1, " Not imposed").otherwise(" ")
    base = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    top = F.when(k % 2 == 0, F.create_map(F.lit("a"), F.lit(9), F.lit("c"), F.lit(7))).otherwise(F.create_map().cast("map<string,int>"))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(scoring.overlay(base, top))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return read(spark, sf_dir, "supplier").select("s_suppkey", scoring.stated(said, F.lit("donor")).alias("value"), listed.alias("settings"))


@query(with_calls("SELECT uid, CAST(CASE WHEN uid % 3 = 0 THEN score + 1 WHEN uid % 3 = 1 THEN -1.0 ELSE score END AS DOUBLE) AS score FROM calls WHERE uid % 2 = 0"))
def memoised_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows is in the memo, a third has other content there, a third is new; odd ones have gone."""
    rows = calls(spark, sf_dir).select("uid", "score", "cents")
    first = state.memoised(rows, spark.createDataFrame([], "uid long, hash string, score double"), "uid", ["uid", "cents"], lambda x: x)
    memo = first.where("uid % 3 <> 2").withColumn("score", F.col("score") + 1).withColumn("hash", F.when(F.col("uid") % 3 == 1, F.lit("old")).otherwise(F.col("hash")))
    now = rows.where("uid % 2 = 0").withColumn("score", F.when(F.col("uid") % 3 == 1, F.lit(-1.0)).otherwise(F.col("score")))
    return state.memoised(now, memo, "uid", ["uid", "cents"], lambda x: x).select("uid", "score")


@query(with_calls("SELECT uid, 'decision' AS field, nullif(decision, '') AS old, 'approved' AS new FROM calls WHERE uid % 2 = 0 AND coalesce(decision, '') <> 'approved'"))
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = calls(spark, sf_dir).select("uid", "decision", "source")
    new = old.where("uid % 2 = 0").withColumn("decision", F.lit(" Approved")).withColumn("source", F.upper("source"))
    return state.changed_fields(old, new, "uid", ["decision", "source"])


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Ann May' WHEN 2 THEN 'Bob' ELSE 'Cyd' END AS shown FROM customer")
def first_name_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first name alone, unless two different fuller names share it; one fuller name merges with the bare first name."""
    k = F.col("c_custkey") % 4
    cell = F.when(k == 0, "Dr. ann LEE").when(k == 1, "Ms ann may").when(k == 2, F.when(F.col("c_custkey") % 8 == 2, "Prof. Bob Ray").otherwise("bob")).otherwise("CYD")
    named = read(spark, sf_dir, "customer").select("c_custkey", text.person(cell).alias("name")).withColumn("first", F.split_part("name", F.lit(" "), F.lit(1)))
    fuller = named.where(F.contains("name", F.lit(" "))).groupBy("first").agg(F.count_distinct("name").alias("n"))
    return named.join(fuller, "first", "left").select("c_custkey", F.when(F.col("n") > 1, F.col("name")).otherwise(F.col("first")).alias("shown"))


_SAID = "['Kenya', 'France', 'East Africa', 'Peru', 'Uganda', 'nowhere'][1 + uid % 6]"


@query(with_calls(f"""SELECT uid, CASE WHEN p = 'Kenya' THEN NULL WHEN p IN ('France', 'Peru', 'Uganda') AND NOT wide THEN 'geography: foreign' WHEN p IN ('France', 'Peru', 'Uganda') THEN 'geography: another country' END AS place,
 uid % 4 = 2 AS country, CASE WHEN uid % 7 = 0 THEN true WHEN uid % 5 = 2 THEN true ELSE false END AS type FROM (SELECT uid, {_SAID} AS p, uid % 3 = 0 AS wide FROM calls)"""))
def applicant_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which place a call names, which countries and which groups of applicants it publishes, against one applicant's."""
    k = F.col("uid")
    said = F.get(F.array(*map(F.lit, ("Kenya", "France", "East Africa", "Peru", "Uganda", "nowhere"))), (k % 6).cast("int"))
    body = F.concat(F.lit("Work in "), said, F.when(k % 3 == 0, " and across East Africa").otherwise(""), F.when(k % 7 == 0, "; only members of the club").otherwise(""))
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    countries = F.when(k % 4 == 0, texts("Peru", "kenya")).when(k % 4 == 1, texts("EAST AFRICA")).when(k % 4 == 2, texts("France")).otherwise(texts())
    types = F.when(k % 5 == 0, texts("NGO")).when(k % 5 == 1, texts("open", "academic")).when(k % 5 == 2, texts("academic", "govt")).when(k % 5 == 3, texts())
    found = geo.places(body)
    fit = geo.strength(found, body, ("Kenya",), ("East Africa",))
    place = F.when(fit == "foreign", "geography: foreign").when((fit == "regional") & op.other_country(found, ("Kenya",)), "geography: another country")
    return calls(spark, sf_dir).select("uid", place.alias("place"), op.applicant_country_mismatch(countries, "Kenya").alias("country"), op.applicant_type_mismatch(types, body, ("ngo",)).alias("type"))


def _kinds(concat: str, name: str, group: str, tier: str) -> list[tuple[str, str]]:
    """(title, text after it) of the eight kinds of calls that geo_gate reads, for either dialect."""
    join = lambda *parts: f"{concat}({', '.join(parts)})"
    plain = "'Health call'"
    return [
        (join("'Health fund: '", name), join("'for '", group)),
        (plain, join("'clinics in '", group)),
        (plain, join("'clinics in '", name, "', open to '", tier)),
        (plain, join("'worldwide, but restricted to '", name, "' and its schools'")),
        (plain, join("'clinics in '", name)),
        (plain, "'clinics and schools'"),
        (plain, join(name, "' within '", group, "' for '", tier)),
        (plain, join("'open to international applicants, as in '", name)),
    ]


def _pick(options: list[str], by: str) -> str:
    return "CASE " + " ".join(f"WHEN {by} % {len(options)} = {i} THEN {x}" for i, x in enumerate(options)) + " END"


_GROUPS, _TIERS = [f"'{g}'" for g in places.regions()], ["'low- and middle-income countries'", "'developing countries'", "'LDCs'"]
_GROUP, _TIER = _pick(_GROUPS, "c_custkey"), _pick(_TIERS, "c_custkey")
#: A country for each nation of the tables, whose own names are numbers.
_COUNTRY = _pick([f"'{c}'" for c in places.countries() if "'" not in c][::7], "n_nationkey")
_MEMBERS = ", ".join(f"('{g}', '{c}')".replace("d'I", "d''I") for g in places.regions() for c in sorted(places.members()[g]))


@query(f"""WITH m(place, country) AS (VALUES {_MEMBERS}), n AS (SELECT n_nationkey, {_COUNTRY} AS name FROM nation),
 c AS (SELECT c_custkey, c_custkey // 8 % 8 AS kind, a.name, b.name AS own, {_GROUP} AS g FROM customer JOIN n a ON a.n_nationkey = c_nationkey JOIN n b ON b.n_nationkey = (c_custkey * 7 + c_nationkey) % 25),
 f AS (SELECT *, name = own AS hit, EXISTS (SELECT 1 FROM m WHERE place = g AND country = own) AS inside FROM c)
 SELECT c_custkey, CASE kind WHEN 0 THEN CASE WHEN hit THEN 'keep' ELSE 'reject' END WHEN 1 THEN CASE WHEN inside THEN 'keep' ELSE 'reject' END WHEN 2 THEN 'keep' WHEN 3 THEN CASE WHEN hit THEN 'keep' ELSE 'reject' END WHEN 4 THEN CASE WHEN hit THEN 'keep' ELSE 'reject' END
  WHEN 5 THEN 'silent' WHEN 6 THEN CASE WHEN inside OR hit THEN 'keep' ELSE 'reject' END ELSE 'keep' END AS verdict,
  CASE kind WHEN 0 THEN CASE WHEN hit THEN 'title' ELSE 'title: ' || name END WHEN 1 THEN CASE WHEN inside THEN 'region' ELSE 'region: ' || g END WHEN 2 THEN 'open or tier' WHEN 3 THEN CASE WHEN hit THEN 'open or tier' ELSE 'restricted to: ' || name END
   WHEN 4 THEN CASE WHEN hit THEN 'country' ELSE 'country: ' || name END WHEN 5 THEN 'no geography' WHEN 6 THEN CASE WHEN inside OR hit THEN 'region' ELSE 'region: ' || g END ELSE 'open or tier' END AS reason FROM f""")
def geo_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's call, in eight kinds of wording over all regions and nations, against the country of another nation."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.expr(_COUNTRY).alias("name"))
    own = nation.toDF("own_key", "own")
    rows = spread(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = rows.join(F.broadcast(own), F.col("own_key") == (F.col("c_custkey") * 7 + F.col("c_nationkey")) % 25)
    rows = rows.withColumns({"g": F.expr(_GROUP), "tier": F.expr(_TIER), "kind": F.floor(F.col("c_custkey") / 8) % 8})
    kinds = _kinds("concat", "name", "g", "tier")
    title, body = (F.expr("CASE " + " ".join(f"WHEN kind = {i} THEN {k[j]}" for i, k in enumerate(kinds)) + " END") for j in (0, 1))
    rows = rows.withColumns({"title": title, "body": body})
    verdict = places.scope(F.col("title"), F.concat_ws(" ", "title", "body"), F.array("own"))
    return rows.select("c_custkey", verdict.alias("v")).select("c_custkey", "v.verdict", "v.reason")


@query(f"""WITH m(place, country) AS (VALUES {_MEMBERS}) SELECT country, string_agg(place, '|' ORDER BY place) AS groups, count(*) AS n FROM m
 WHERE country IN (SELECT {_COUNTRY} FROM nation) GROUP BY 1""")
def place_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions and blocs that take in each nation's country, through the hierarchy."""
    wanted = read(spark, sf_dir, "nation").select(places.canonical(F.upper(F.expr(_COUNTRY))).alias("name")).distinct()
    pairs = places.hierarchy(spark).where(F.col("place").isin(*places.regions()))
    return pairs.join(wanted, F.col("country") == F.col("name")).groupBy("country").agg(F.array_join(F.array_sort(F.collect_list("place")), "|").alias("groups"), F.count("*").alias("n"))
