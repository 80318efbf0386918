"""Operator 12, quality rules: robust multivariate outliers, with DataFrame functions alone.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return. A text fails the base
rules if it has fewer than ``LEAST_WORDS`` words, or if more than half of them lie in three-word windows that occur twice
or more in the text. Of the others, per language and source, the minimum-covariance-determinant estimate of place and
scatter is sought, and texts too far from it are rejected:

1. A text's counts become a vector of ``FEATURES``: logarithms of the mean length of its words, and of one plus ten times
   its symbols a word, its repeated lines a line and its repeated words a word, in steps of 1 / ``STEPS``. Equal vectors
   of a group are one row with a count, so a group of copies is one row.
2. Two starts per group: medians with median absolute deviations, and the moments of all its texts.
3. Concentration steps: of each group the ``SHARE`` of texts that are nearest by Mahalanobis distance give new moments.
   A step is one pass: moments are summed per bin of distance, and the bins up to the share's are added up. Sums are
   whole numbers, so they don't depend on the order of rows. ``ROUNDS`` steps lower the determinant from both starts.
4. Of each group the start with the smaller determinant stays. Its scatter is widened where the median distance is above
   the one of a normal sample. A text whose squared distance exceeds ``REJECT`` fails.

``FLOORS`` are added to the scatter's diagonal, which regularises it: most texts have no symbol at all, so a subset's
scatter would be singular, and any text with one symbol infinitely far.

A group of fewer than ``LEAST_TEXTS`` texts takes the estimate of its language, and a language with fewer that of all
texts; if these are fewer too, no text is an outlier. A null language or source is a value of its own.

Groups may be many, or one may hold most texts: vectors meet estimates by a broadcast of a checked size or by a salted
join, sums are made in each task before they shuffle, and a group has at most ``BINS`` bins.

Defined results: a null text is empty, has no words and fails the base rules; repeated rows are judged alike; an empty
table gives no rows; other columns are not read. Three-word windows are compared by hashes of 64 bits, inside a text
only. A row is worked on alone, in memory in proportion to its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinionmill.plans.joins import lookup_join

from .common import fresh, pinned

#: Fixed values.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50

FEATURES = ("length", "symbols", "lines", "repeats")
STEPS = 1024
#: Standard deviations that a scatter has at least, by feature.
FLOORS = (0.05, 0.1, 0.4, 0.4)
SHARE = 0.75
ROUNDS = 5
LEAST_TEXTS = 50
#: Quantiles of the chi-squared distribution with four degrees of freedom, of 0.5 and 0.999999.
MEDIAN, REJECT = 3.3567, 33.377
#: Bins of squared distance, 256 for each factor of e.
BINS = 4096

SIZE = len(FEATURES)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i + 1)]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more."""

    def of(all_: Column) -> Column:
        hashes = F.transform(all_, lambda w, i: F.xxhash64(w, F.get(all_, i + 1), F.get(all_, i + 2)))
        return let(F.slice(hashes, 1, F.greatest(F.size(all_) - 2, F.lit(0))), within)

    def within(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(placed, covered))

    def covered(placed: Column) -> Column:
        def again(e: Column, j: Column) -> Column:
            return F.coalesce(F.get(placed, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(
                F.get(placed, j + 1)["h"] == e["h"], F.lit(False))

        places = F.transform(F.filter(placed, again), lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    return let(words, of)


def counted(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with the counts of the whole text, ``n_lines`` (lines with a word) and ``base_failed``."""
    text, words, lines = (fresh(documents, n) for n in ("_text", "_words", "_lines"))
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = documents.select(
        *[F.col(f"`{c}`") for c in keep], whole.alias(text),
        F.array_remove(F.split(whole, "[\\x20\\x09-\\x0D]+"), "").alias(words),
        F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "").alias(lines),
    )

    # Most texts have no symbol, and looking is cheaper than taking them out.
    symbols = F.when(F.col(text).rlike("[#*$%&|<>]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(0)
    rows = parts.select(
        *[F.col(f"`{c}`") for c in keep], F.size(words).alias("n_words"),
        F.length(F.array_join(words, "")).alias("word_chars"), symbols.alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        _repeat_words(F.col(words)).alias("n_repeat_words"), F.size(lines).alias("n_lines"),
    )
    return rows.withColumns({c: F.col(c).cast("long") for c in (*COUNTS, "n_lines")}).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    )


def vector() -> list[Column]:
    """The features of counted rows as whole steps; null where there are no words."""
    words = F.col("n_words")
    share = lambda n, of: F.ln(1 + F.try_divide(10 * F.col(n), of))
    values = (F.ln(F.try_divide(F.col("word_chars"), words)), share("n_symbols", words), share("n_dup_lines", F.col("n_lines")),
              share("n_repeat_words", words))
    return [F.round(v * STEPS).cast("long").alias(name) for v, name in zip(values, FEATURES)]


def levels() -> list[Column]:
    """Names of a row's groups: its language and source, its language, all rows."""
    return [F.to_json(F.array(F.col("lang").cast("string"), F.col("source").cast("string")), {"ignoreNullFields": "false"}),
            F.to_json(F.array(F.col("lang").cast("string")), {"ignoreNullFields": "false"}), F.lit("")]


def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with ``crowd``, the narrowest of their groups that has enough texts; null where none has."""
    passed = rows.where(~F.col("base_failed"))
    own, language, everyone = levels()
    sizes = pinned(passed.groupBy(own.alias("own"), language.alias("language")).agg(F.count("*").alias("n")))
    languages = sizes.groupBy("language").agg(F.sum("n").alias("of_language"))
    enough = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)) >= LEAST_TEXTS).first()[0]
    named = lookup_join(sizes, languages, "language", ["own"]).select(
        "own", F.when(F.col("n") >= LEAST_TEXTS, F.col("own")).when(F.col("of_language") >= LEAST_TEXTS, F.col("language"))
        .otherwise(everyone if enough else F.lit(None)).alias("crowd"))
    return lookup_join(rows.withColumn("own", own).withColumn("language", language), pinned(named), "own", ["doc_id"])


def members(rows: DataFrame) -> DataFrame:
    """(crowd, features, n): the vectors of all texts of every group that some text takes its estimate from."""
    passed = rows.where(~F.col("base_failed") & F.col("crowd").isNotNull())
    wanted = passed.groupBy("crowd").agg(F.lit(True).alias("wanted"))
    each = passed.select(F.explode(F.array(F.col("own"), F.col("language"), F.lit(""))).alias("crowd"), *vector())
    # Equal vectors of a group are counted before they meet the wanted groups.
    counts = each.groupBy("crowd", *FEATURES).agg(F.count("*").alias("n"))
    return lookup_join(counts, pinned(wanted), "crowd", list(FEATURES)).where("wanted").drop("wanted")


def _at_share(rows: DataFrame, by: list[str], order: str, n: str, share: float) -> DataFrame:
    """For each ``by`` the smallest ``order`` up to which this share of the counts ``n`` lies; few rows per ``by``."""
    window = Window.partitionBy(*by)
    up_to = F.sum(n).over(window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*by, order, up_to.alias("_up"), F.sum(n).over(window).alias("_all")).where(
        F.col("_up") >= F.col("_all") * share).groupBy(*by).agg(F.min(order).alias("at"))


def _estimates(moments: DataFrame, by: list[str]) -> DataFrame:
    """Means ``m0``..., the inverse ``r00``, ``r10``... of the scatter's Cholesky factor, and the determinant's logarithm.

    ``moments`` has ``m0``... and the scatter ``c00``, ``c10``..., in whole steps or not, without floors.
    """
    out = moments
    for i, j in PAIRS:
        floor = (FLOORS[i] * STEPS) ** 2 if i == j else 0.0
        rest = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        left = F.col(f"c{i}{j}") + floor - rest
        out = out.withColumn(f"l{i}{j}", F.sqrt(left) if i == j else left / F.col(f"l{j}{j}"))
    for i, j in PAIRS:
        unit = F.lit(1.0 if i == j else 0.0)
        rest = sum((F.col(f"l{i}{k}") * F.col(f"r{k}{j}") for k in range(j, i)), F.lit(0.0))
        out = out.withColumn(f"r{i}{j}", (unit - rest) / F.col(f"l{i}{i}"))
    size = sum((F.ln(f"l{i}{i}") for i in range(SIZE)), F.lit(0.0))
    return out.select(*by, *[f"m{i}" for i in range(SIZE)], *[f"r{i}{j}" for i, j in PAIRS], size.alias("log_determinant"))


def distance() -> Column:
    """The squared Mahalanobis distance of a row with features and estimates."""
    off = [F.col(name) - F.col(f"m{i}") for i, name in enumerate(FEATURES)]
    turned = [sum((F.col(f"r{i}{j}") * off[j] for j in range(i + 1)), F.lit(0.0)) for i in range(SIZE)]
    return sum((t * t for t in turned), F.lit(0.0))


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts, sums and sums of products, all whole, of rows with a count ``n``."""
    return rows.groupBy(*by).agg(
        F.sum("n").alias("n"), *[F.sum(F.col(f) * F.col("n")).alias(f"s{i}") for i, f in enumerate(FEATURES)],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j]) * F.col("n")).alias(f"q{i}{j}") for i, j in PAIRS])


def _moments(sums: DataFrame, by: list[str]) -> DataFrame:
    """Means and scatter of sums, summed up per ``by``."""
    names = ["n", *[f"s{i}" for i in range(SIZE)], *[f"q{i}{j}" for i, j in PAIRS]]
    total = sums.groupBy(*by).agg(*[F.sum(c).cast("double").alias(c) for c in names])
    mean = [F.col(f"s{i}") / F.col("n") for i in range(SIZE)]
    return total.select(*by, *[m.alias(f"m{i}") for i, m in enumerate(mean)],
                        *[(F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]).alias(f"c{i}{j}") for i, j in PAIRS])


def _robust_start(rows: DataFrame) -> DataFrame:
    """Medians, and median absolute deviations as a scatter without covariances."""
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).alias("value")) for i, f in enumerate(FEATURES)])
    by = ["crowd", "feature"]
    values = pinned(rows.select("crowd", "n", F.explode(pairs).alias("p")).groupBy(
        "crowd", F.col("p.feature").alias("feature"), F.col("p.value").alias("value")).agg(F.sum("n").alias("n")))
    middle = _at_share(values, by, "value", "n", 0.5)
    # Both sides are grouped the same way, and a feature has a bounded number of steps.
    off = values.join(middle, by).groupBy(*by, "at", F.abs(F.col("value") - F.col("at")).alias("off")).agg(F.sum("n").alias("n"))
    spread = _at_share(off, [*by, "at"], "off", "n", 0.5).toDF(*by, "middle", "spread")
    each = lambda i, what: F.max(F.when(F.col("feature") == i, F.col(what)))
    return spread.groupBy("crowd").agg(
        *[each(i, "middle").cast("double").alias(f"m{i}") for i in range(SIZE)],
        *[(F.pow(each(i, "spread") * 1.4826, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS])


def estimates(rows: DataFrame) -> DataFrame:
    """(crowd, estimates, wider): the minimum-covariance-determinant estimate of each group of :func:`members`."""
    by = ["crowd", "start"]
    robust = _robust_start(rows).withColumn("start", F.lit(0))
    plain = _moments(_summed(rows, ["crowd"]), ["crowd"]).withColumn("start", F.lit(1))
    found = pinned(_estimates(robust.unionByName(plain), by))
    bin_ = F.least(F.floor(256 * F.ln(1 + distance())), F.lit(BINS - 1)).cast("int")

    def binned(params: DataFrame) -> DataFrame:
        held = params.groupBy("crowd").agg(F.collect_list(F.struct(*[c for c in params.columns if c != "crowd"])).alias("held"))
        met = lookup_join(rows, pinned(held), "crowd", list(FEATURES))
        each = met.select(*rows.columns, F.explode("held").alias("e")).select(*rows.columns, "e.*")
        return pinned(_summed(each.withColumn("bin", bin_), [*by, "bin"]))

    for _ in range(ROUNDS):
        sums = binned(found)
        near = _at_share(sums, by, "bin", "n", SHARE)
        found = pinned(_estimates(_moments(sums.join(near, by).where(F.col("bin") <= F.col("at")), by), by))
    best = found.groupBy("crowd").agg(F.min_by(F.struct(*found.columns), F.struct("log_determinant", "start")).alias("b")).select("b.*")
    middle = _at_share(binned(best), by, "bin", "n", 0.5)
    wider = F.greatest(F.lit(1.0), (F.exp((F.col("at") + 1) / 256) - 1) / MEDIAN)
    return best.join(middle.select(*by, wider.alias("wider")), by).drop("start")


def judged(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with the counts, ``base_failed``, the squared ``distance`` and ``kept``.

    ``keep`` has at least doc_id, lang and source.
    """
    rows = pinned(grouped(pinned(counted(documents, keep))))
    held = estimates(pinned(members(rows)))
    names = [c for c in held.columns if c != "crowd"]
    packed = held.select("crowd", F.struct(*names).alias("estimate"))
    met = lookup_join(rows, pinned(packed), "crowd", ["doc_id"])
    near = met.select(*rows.columns, "estimate.*", *vector()).withColumn("distance", distance() / F.col("wider"))
    fine = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= REJECT))
    return near.select(
        *keep, *COUNTS, "base_failed", F.when(~F.col("base_failed"), F.col("distance")).alias("distance"), fine.alias("kept"))


def judge(documents: DataFrame) -> DataFrame:
    """Counts and verdict of every document."""
    return judged(documents.select("doc_id", "text", "lang", "source"), ["doc_id", "lang", "source"]).drop("lang", "source")
