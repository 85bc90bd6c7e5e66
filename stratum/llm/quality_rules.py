"""Quality rules whose cutoffs carry a guarantee, in DataFrame functions only.

Each rule divides a count of a document by another (symbols per word, repeated lines per line,
...) and rejects from a cutoff on. The rules are tightened in one fixed order (``STEPS``): each in
turn from its loosest cutoff to its strictest, so a later step rejects whatever an earlier one
does. For every stratum (language) and step, the holdout's good documents that the step's cutoffs
together would reject are counted. A step is certified if so few rejections would be improbable
were the true rate above ``alpha``: the exact binomial tail P(X <= k; n, alpha) is at most ``delta``
shared out over the strata (Bonferroni). That is the exact upper (Clopper-Pearson) bound at that
confidence lying below alpha. Over the steps no share is needed: they are tested in their order,
up to the first that fails. The last certified step's cutoffs are used; without one all rules are
off in that stratum.

The holdout of a stratum is its documents labelled good that pass the base rules. So with
probability 1 - delta, in all strata at once, at most alpha of the good documents that pass the base
rules are rejected. The base rules are given, not chosen, and what they reject has no guarantee;
``certificates`` reports it beside the rest.

Words are runs without ASCII white space; three-word windows are compared by 64-bit hashes.
Defined results: a null or empty text has no words, fails the base rules and has zero counts;
a null language is a stratum of its own; a document labelled more than once counts as good
if any label is; rows of one doc_id and language count once in the holdout, as rejected if any
of them is; labels without document or with null quality are ignored; repeated rows and rows
without doc_id are judged each; other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.shared import materialize, small

WORD, SPACE, SYMBOL = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
ALPHA, DELTA = 0.02, 0.05
#: Rule: numerator, denominator (both longs of ``features``), cutoffs in thousandths, strictest first.
RULES = {
    "symbols": ("n_symbols", "n_words", [20, 50, 100, 150, 200, 300, 400, 500, 700, 1000]),
    "duplicate_lines": ("n_dup_lines", "n_lines", [50, 100, 150, 200, 250, 300, 400, 500, 700, 900]),
    "repeated_words": ("n_repeat_words", "n_words", [10, 20, 50, 100, 150, 200, 250, 300, 400, 450]),
    "capital_letters": ("n_capitals", "word_chars", [50, 80, 100, 150, 200, 300, 400, 500, 600, 800]),
    "long_words": ("word_chars", "n_words", [5500, 6000, 6500, 7000, 8000, 9000, 10000, 12000, 15000, 20000]),
}
#: Rule and cutoff that each step adds, the loosest cutoffs first.
STEPS = [(rule, RULES[rule][2][-i]) for i in range(1, 11) for rule in RULES]
POSITION_BITS = 24


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first occurrence included.

    Windows are sorted by 40 bits of their hash with their place below; neighbours that share
    those bits are compared by all 64. Only where two different windows share 40 bits can equal
    ones stand apart, and such a text is sorted by whole hashes instead."""
    mask = (1 << POSITION_BITS) - 1

    def covered(places: Column) -> Column:  # ascending first words of repeated windows
        return F.aggregate(
            places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
            lambda s, p: F.struct((s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"],
        )

    def slow(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        return _let(pairs, lambda s: covered(F.array_sort(F.transform(F.filter(
            s, lambda x, j: (F.get(s, j - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(x["h"]))), lambda x: x["i"]))))

    def quick(h: Column, codes: Column) -> Column:
        place = lambda c: c.bitwiseAND(mask)
        whole = lambda c: F.get(h, place(c).cast("int"))
        high = lambda c: F.shiftrightunsigned(c, POSITION_BITS)
        near = F.filter(codes, lambda c, j: (high(c) == high(F.get(codes, j - 1))) | (high(c) == high(F.get(codes, j + 1))))
        clash = lambda s: F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda j: (high(F.get(s, j)) == high(F.get(s, j - 1))) & (whole(F.get(s, j)) != whole(F.get(s, j - 1))))
        return _let(near, lambda s: F.when(F.size(s) < 2, F.lit(0).cast("long")).when(clash(s), slow(h)).otherwise(covered(F.array_sort(F.transform(s, place)))))

    def count(w: Column) -> Column:
        h = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        code = lambda x, i: F.shiftleft(x, POSITION_BITS).bitwiseOR(i.cast("long"))
        return _let(h, lambda h: F.when(F.size(h) > mask, slow(h)).otherwise(_let(F.sort_array(F.transform(h, code)), lambda c: quick(h, c))))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(words, count))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every document."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text"))
    words, own_lines = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    # a generator keeps the optimizer from computing the words again for each count
    df = df.select("doc_id", "lang", "text", F.explode(F.array(F.struct(words.alias("w"), own_lines.alias("l")))).alias("x"))
    return df.select(
        "doc_id", "lang", F.size("x.w").cast("long").alias("n_words"),
        (F.char_length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.col("x.l.n") - F.col("x.l.distinct")).cast("long").alias("n_dup_lines"), repeated_words(F.col("x.w")).alias("n_repeat_words"),
        F.col("x.l.n").cast("long").alias("n_lines"), F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, from 20 on."""
    x = F.greatest(n.cast("double"), F.lit(20.0))
    series = x * F.log(x) - x + F.log(2 * F.pi() * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n < 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial variable for k below its mean n * p, else 1 (there it is over a quarter).

    Below the mean the terms fall from k downwards, so the sum starts there and ends where what is
    left is under 1e-20 of it: after a number of terms that grows as the root of n."""
    last = F.least(k, F.ceil(F.lit(12.0) * F.sqrt(n * p)) + 60)

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * (k - j + 1) * (1 - p) / ((n - k + j) * p)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    terms = F.when(last < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(last, F.lit(1).cast("long"))))
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(first + F.log(F.aggregate(terms, one, step, lambda s: s["sum"]))))


def rejects(rule: str, cutoff: int) -> Column:
    above, below, _ = RULES[rule]
    return F.coalesce((1000 * F.col(above) >= cutoff * F.col(below)) & (F.col(below) > 0), F.lit(False))


def rejected_from(rule: str) -> Column:
    """The first step at which a rule rejects a row (null: none)."""
    return F.coalesce(*(F.when(rejects(rule, c), F.lit(i)) for i, (r, c) in enumerate(STEPS, 1) if r == rule))


def certificates(found: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Of each stratum: lang, good (documents labelled good), base_rejected (of these, by the base rules),
    n (the others), step (the last certified one, null: none) and rejected (of n, by its cutoffs)."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    step = F.least(*(rejected_from(rule) for rule in RULES))
    holdout = found.withColumn("from", F.when(base_failed(), 0).otherwise(F.coalesce(step, F.lit(len(STEPS) + 1))))
    holdout = holdout.join(good, "doc_id").groupBy("lang", "doc_id").agg(F.min("from").alias("from"))
    n_from = lambda i: F.count_if(F.col("from") == i)
    counts = holdout.groupBy("lang").agg(
        F.count("*").alias("good"), n_from(0).alias("base_rejected"), F.array(*(F.count_if(F.col("from").between(1, i)) for i in range(1, len(STEPS) + 1))).alias("rejections")
    )
    counts = materialize(counts.withColumn("n", F.col("good") - F.col("base_rejected")), "strata")
    bound = delta / max(1, counts.where("n > 0").count())
    passed = F.transform("rejections", lambda k: binomial_tail(k, F.col("n"), alpha) <= bound)
    step = F.size(F.filter(passed, lambda x: x))  # rejections only rise along the steps, so those that pass come first
    found = counts.withColumn("step", F.when((F.col("n") > 0) & (step > 0), step))
    return found.select("lang", "good", "base_rejected", "n", "step", F.get("rejections", F.col("step") - 1).alias("rejected"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Every document with its counts, base_failed, the rules that reject it and ``kept``."""
    found = materialize(features(docs), "features")
    steps = small(materialize(certificates(found, labels, alpha, delta).select("lang", "step"), "steps"))
    judged = found.join(steps, "lang", "left").withColumn("base_failed", base_failed())
    rules = F.array_compact(F.array(*(F.when(rejected_from(rule) <= F.col("step"), F.lit(rule)) for rule in RULES)))
    return judged.withColumn("rejected_by", rules).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("step")
