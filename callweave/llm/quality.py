"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule is a number per document (share of repeated words, of duplicate lines, symbols and capitals per
character, ...) and rejects above its cutoff. A level holds one cutoff for each rule; from one level to the next
no cutoff rises, so each level rejects what the one before rejects. For each stratum the levels are tested in this
fixed order on labelled holdouts: of n good documents the level's rules together reject k, and the exact binomial
tail P(Bin(n, alpha) <= k) is the p-value of "this level rejects more than alpha of the good". Testing stops at the
first level whose p-value is above delta / strata; the one before is applied. A fixed sequence needs no correction
for its length, and Bonferroni covers the strata: with a probability of 1 - delta no stratum loses more than alpha
of its good documents to all rules together. A stratum too small for the first level applies no rule.

Edge cases: null and empty texts have no words and fail the base rule. Null strata form a stratum of their own.
Labels that are null are not used; without labels only the base rule rejects. Repeated rows each get a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, cut, stored

SYMBOLS = "#*$%&|<>"
#: The cutoffs of each rule in thousandths, from the mildest level to the strictest; integers keep every comparison exact.
LEVELS = {
    "r_symbols": (500, 400, 300, 250, 200, 150, 100, 80, 60, 40, 30, 20),
    "r_dup_lines": (950, 900, 850, 800, 700, 600, 500, 450, 400, 350, 300, 250),
    "r_repeat": (500, 490, 480, 470, 450, 430, 400, 380, 350, 320, 300, 250),
    "r_exclaim": (500, 400, 300, 250, 200, 150, 100, 80, 60, 50, 40, 30),
    "r_capitals": (950, 900, 850, 800, 700, 600, 500, 450, 400, 350, 300, 250),
}
ALPHA, DELTA = 0.025, 0.05
MIN_WORDS = 50


#: Up to so many repeated windows their places are found by scanning; beyond, by sorting (hash, place) pairs.
FEW_REPEATS = 16


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), "")


def _window_hashes(words: Column) -> Column:
    """The 64-bit hash of every window of three words, in order."""
    at = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), at)).otherwise(F.array().cast("array<bigint>"))


def _repeated_places() -> Column:
    """Sorted starts of the windows found twice or more, from __h (hashes), __r (repeated hashes) and __q (sorted pairs)."""
    h, r, pairs = F.col("__h"), F.col("__r"), F.col("__q")
    scan = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(r, F.get(h, i)))
    none = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(-1).alias("p")))
    near = F.arrays_zip(pairs.alias("x"), F.concat(none, pairs).alias("y"), F.slice(pairs, F.lit(2), F.size(h)).alias("z"))
    hits = F.filter(near, lambda v: (v["x"]["h"] == v["y"]["h"]) | (v["x"]["h"] == v["z"]["h"]))
    by_sort = F.sort_array(F.transform(hits, lambda v: v["x"]["p"]))
    return F.when(F.size(r) == 0, F.array().cast("array<int>")).when(F.size(r) <= FEW_REPEATS, scan).otherwise(by_sort)


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_exclaim and n_capitals."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    staged = docs.select("*", _words(F.col(text)).alias("__w"), lines.alias("__l"), count(f"[{SYMBOLS}]").alias("n_symbols"), (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaim"), count("[A-Z]").alias("n_capitals"))
    w, lines = F.col("__w"), F.col("__l")
    counted = staged.select(
        *[c for c in staged.columns if c not in ("__w", "__l")],
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _window_hashes(w).alias("__h"),
    )
    h, s = F.col("__h"), F.col("__s")
    order = counted.withColumn("__s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)).otherwise(F.array().cast("array<bigint>")))
    repeats = order.withColumn("__r", F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1)))).drop("__s")
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    paired = repeats.withColumn("__q", F.when(F.size("__r") > FEW_REPEATS, pairs))
    marked = paired.withColumn("__p", _repeated_places()).drop("__h", "__r", "__q")
    # the starts are sorted: each covers three words, less the overlap with the one before
    covered = F.aggregate(
        F.col("__p"),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"].cast("long"),
    )
    return marked.withColumn("n_repeat_words", covered).drop("__p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rule_values(df: DataFrame) -> DataFrame:
    chars, words, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("word_chars", "n_words", "n_lines"))
    per = lambda part, whole: F.floor(F.col(part) * 1000 / whole)
    return df.withColumns({"r_symbols": per("n_symbols", chars), "r_dup_lines": per("n_dup_lines", lines), "r_repeat": per("n_repeat_words", words), "r_exclaim": per("n_exclaim", chars), "r_capitals": per("n_capitals", chars)})


def log_binomial_tail(n: Column, k: Column, alpha: float) -> Column:
    """log P(Bin(n, alpha) <= k), exactly summed in logarithms; 0 where k >= n * alpha, as no such cutoff is safe."""
    la, lb = F.log(F.lit(alpha)), F.log(F.lit(1 - alpha))
    first = n * lb
    term = lambda acc, i: acc["t"] + F.log(n - i + 1) - F.log(i.cast("double")) + la - lb

    def step(acc: Column, i: Column) -> Column:
        t = term(acc, i)
        top = F.greatest(acc["s"], t)
        return F.struct(t.alias("t"), (top + F.log(F.exp(acc["s"] - top) + F.exp(t - top))).alias("s"))

    seq = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(seq, F.struct(first.alias("t"), first.alias("s")), step, lambda acc: acc["s"])
    return F.when(k < n * alpha, tail).otherwise(F.lit(0.0))


def first_rejecting(levels: dict[str, tuple[int, ...]] = LEVELS) -> Column:
    """The first level whose rules reject the row; the number of levels if none does."""
    passes = lambda rule: lambda cutoff: F.col(rule) <= cutoff
    return F.least(*[F.size(F.filter(F.array(*map(F.lit, cutoffs)), passes(rule))) for rule, cutoffs in levels.items()])


def safe_levels(counts: DataFrame, n_levels: int, alpha: float = ALPHA, delta: float = DELTA, strata: int | None = None) -> DataFrame:
    """counts: (stratum, n, k: rejected good documents at each level). (stratum, level): the last level before the first that fails its test."""
    tests = max(strata if strata is not None else counts.count(), 1)
    failed = [F.when(log_binomial_tail(F.col("n").cast("double"), F.get("k", F.lit(i)), alpha) > F.log(F.lit(delta / tests)), i) for i in range(n_levels)]
    return counts.select("stratum", (F.coalesce(*failed, F.lit(n_levels)) - 1).alias("level")).where("level >= 0")


def _levels_of(stats: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(stratum, level) from the good labelled documents that pass the base rule; stats: (doc_id, lang, base_failed, first)."""
    n = len(next(iter(LEVELS.values())))
    held = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("__key")).distinct()
    rows = stats.where(~F.col("base_failed")).select(F.col("doc_id").alias("__key"), F.col("lang").alias("stratum"), "first").join(held, "__key", "left_semi")
    # one row per stratum: all counts come from one aggregation with map-side sums
    per = cut(rows.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("first") <= i) for i in range(n)]).alias("k")))
    return stored(safe_levels(per, n, alpha, delta), "levels")  # a file of known size: a broadcast below the threshold, a join beyond it


def _stats(docs: DataFrame) -> DataFrame:
    return _rule_values(text_stats(docs).withColumn("base_failed", base_failed())).withColumn("first", first_rejecting())


def _kept() -> Column:
    return ~F.col("base_failed") & F.coalesce(F.col("first") > F.col("level"), F.lit(True))


def judge_quality(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", key: str = "doc_id", good: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, lang), the statistics, the first level that rejects, the stratum's level and the verdict `kept`; the text itself is not returned."""
    slim = docs.select(F.col(key).alias("doc_id"), F.col(stratum).alias("lang"), F.col(text).alias("text"))
    stats = cut(_stats(slim).drop("text"))
    levels = _levels_of(stats, labels.select(F.col(key).alias("doc_id"), F.col(good).alias("quality")), alpha, delta)
    return stats.join(levels, stats["lang"].eqNullSafe(levels["stratum"]), "left").drop("stratum").withColumn("kept", _kept())


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", key: str = "doc_id", good: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that are kept. The rows are written once beside their statistics, so no text is counted twice or shuffled."""
    packed = docs.select(F.col(key).alias("doc_id"), F.col(stratum).alias("lang"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stats = stored(_stats(packed).select("doc_id", "lang", "base_failed", "first", "row"), "quality")
    levels = _levels_of(stats, labels.select(F.col(key).alias("doc_id"), F.col(good).alias("quality")), alpha, delta)
    return stats.join(levels, stats["lang"].eqNullSafe(levels["stratum"]), "left").where(_kept()).select("row.*")
