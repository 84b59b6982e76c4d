"""Quality rules and robust multivariate outliers, in DataFrame operations only.

Base rules reject short texts and texts that repeat themselves. The rest are vectors of transformed statistics; for
every language and source a minimum covariance determinant estimate is fitted and texts far from it in Mahalanobis
distance are rejected. The fit starts from medians and quartile ranges and takes concentration steps: the ``COVERAGE``
part of the rows nearest to the estimate gives the next one. Vectors are rounded to fixed steps, so that all sums are
exact and reruns agree; the nearest part is cut on fine bins of the distance, so that one aggregation makes a step and
no group is ever sorted or gathered. Every group has an estimate of its own, drawn towards that of its language as if
``MIN_ROWS`` more rows were like it, and languages towards that of all; so small groups are judged much as their language
is and large ones by themselves, without a switch. The estimate of all is drawn towards a wide one by ``WIDE_ROWS`` rows,
so in a table of a few rows hardly any is far.

Null text has no words and fails the base rules; null language and source are values like any other. Repeated rows
weigh as often as they appear. An empty table gives an empty result. Added columns start with ``q_``; columns of the
names in ``ADDED`` are replaced, all others kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import let, staged, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
COVERAGE = 0.75
#: Rows of the wider group that weigh with each group's own.
MIN_ROWS = 200
STEPS = 5
#: Probability under a normal bulk that a clean text is kept.
CONFIDENCE = 0.9999
#: Steps that a statistic is rounded to, per unit.
GRID = 1024
#: Words and lines added to every text's counts, so that short texts do not stray by chance.
PRIOR_WORDS, PRIOR_LENGTH, PRIOR_LINES = 50.0, 5.0, 10.0
#: Statistics of a vector and the spread each has at least.
AXES = {"q_length": 0.03, "q_symbols": 0.03, "q_lines": 0.1, "q_repeats": 0.1, "q_stutter": 0.03}
P = len(AXES)
#: Rows and spread of the estimate that the whole table is drawn towards.
WIDE_ROWS, WIDE = 6, 0.5
ADDED = ("q_n_words", "q_word_chars", "q_n_symbols", "q_n_lines", "q_n_dup_lines", "q_n_repeat_words", "q_n_stutter", "q_base_failed", *AXES, "q_distance", "q_kept")
BINS_PER_LOG = 64


def chi_square_cdf(x: float, k: int) -> float:
    """By the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, k) < p else (low, middle)
    return (low + high) / 2


def repeated_words(tokens: Column, size: int = WINDOW) -> Column:
    """Words of windows of ``size`` words that are found twice or more in the same text."""
    n = F.size(tokens)
    hashes = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[tokens.getItem(i + k) for k in range(size)]))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def of(s: Column) -> Column:
            last = F.size(s) - 1
            twice = F.filter(s, lambda e, i: ((i > 0) & (s.getItem(F.greatest(i - 1, F.lit(0)))["x"] == e["x"])) | ((i < last) & (s.getItem(F.least(i + 1, last))["x"] == e["x"])))
            at = F.sort_array(F.transform(twice, lambda e: e["i"]))
            return let(at, lambda a: F.aggregate(F.sequence(F.lit(1), F.size(a) - 1), F.lit(size), lambda sum_, k: sum_ + F.least(F.lit(size), a.getItem(k) - a.getItem(k - 1))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(placed, of))

    return F.when(n < size + 1, 0).otherwise(let(hashes, covered)).cast("long")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), q_base_failed and the vector."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.withColumns(
        {
            "q_words": words(F.col(text_col)),
            "q_all_lines": lines,
            "q_word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "q_n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        }
    )
    n = F.size("q_words")
    again = F.size(F.filter(F.zip_with(F.slice("q_words", 1, F.greatest(n - 1, F.lit(0))), F.slice("q_words", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    counted = first.withColumns(
        {
            "q_n_words": n.cast("long"),
            "q_n_lines": F.size("q_all_lines").cast("long"),
            "q_n_dup_lines": (F.size("q_all_lines") - F.size(F.array_distinct("q_all_lines"))).cast("long"),
            "q_n_repeat_words": repeated_words(F.col("q_words")),
            "q_n_stutter": F.when(n > 1, again).otherwise(0).cast("long"),
        }
    ).drop("q_words", "q_all_lines")
    padded = F.col("q_n_words") + PRIOR_WORDS
    vector = {
        "q_length": F.log((F.col("q_word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / padded),
        "q_symbols": F.log1p(F.col("q_n_symbols") / padded),
        "q_lines": F.col("q_n_dup_lines") / (F.col("q_n_lines") + PRIOR_LINES),
        "q_repeats": F.col("q_n_repeat_words") / padded,
        "q_stutter": F.col("q_n_stutter") / padded,
    }
    failed = (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_n_words"))
    return counted.withColumns({name: F.round(x * GRID).cast("long") for name, x in vector.items()} | {"q_base_failed": failed})


def _cholesky(cov: list[list[Column]]) -> dict[str, Column]:
    """Columns l_ij of the lower factor, to be added one after the other."""
    out: dict[str, Column] = {}
    for i in range(P):
        for j in range(i + 1):
            rest = cov[i][j]
            for k in range(j):
                rest = rest - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            out[f"l_{i}{j}"] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}{j}")
    return out


def _estimate(moments: DataFrame, scale: float) -> DataFrame:
    """Means and the factor of the covariance from sums n, s_i, s_ij of a group."""
    n = F.col("n").cast("double")
    means = moments.withColumns({f"mu_{i}": F.col(f"s_{i}") / n for i in range(P)})
    floor = list(AXES.values())
    cov = [[(F.col(f"s_{i}{j}") / n - F.col(f"mu_{i}") * F.col(f"mu_{j}")) * scale + (F.lit((floor[i] * GRID) ** 2) if i == j else F.lit(0.0)) for j in range(i + 1)] for i in range(P)]
    for name, column in _cholesky(cov).items():
        means = means.withColumn(name, column)
    return means.select("g", *[f"mu_{i}" for i in range(P)], *[f"l_{i}{j}" for i in range(P) for j in range(i + 1)])


def distance() -> Column:
    """Squared Mahalanobis distance of a row joined to its group's estimate, by forward substitution."""
    y: list[Column] = []
    for i, axis in enumerate(AXES):
        rest = F.col(axis) - F.col(f"mu_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}{k}") * y[k]
        y.append(rest / F.col(f"l_{i}{i}"))
    total = y[0] * y[0]
    for v in y[1:]:
        total = total + v * v
    return total


SUMS = ("n", *[f"s_{i}" for i in range(P)], *[f"s_{i}{j}" for i in range(P) for j in range(i + 1)])


def _start(vectors: DataFrame) -> DataFrame:
    """``(g, mu_i, l_ij)``: medians and quartile ranges of every ``q_group``."""
    floor = list(AXES.values())
    quartiles = vectors.groupBy(F.col("q_group").alias("g")).agg(*[F.percentile(a, [0.25, 0.5, 0.75]).alias(f"p_{i}") for i, a in enumerate(AXES)])
    start = {f"mu_{i}": F.col(f"p_{i}").getItem(1) for i in range(P)}
    spread = [F.greatest((F.col(f"p_{i}").getItem(2) - F.col(f"p_{i}").getItem(0)) / 1.349, F.lit(floor[i] * GRID)) for i in range(P)]
    factor = {f"l_{i}{j}": spread[i] if i == j else F.lit(0.0) for i in range(P) for j in range(i + 1)}
    return staged(quartiles.select("g", *[c.alias(n) for n, c in (start | factor).items()]), "estimate")


def _wide(start: DataFrame) -> DataFrame:
    """Sums of ``WIDE_ROWS`` rows spread widely around the medians."""
    mu = [F.col(f"mu_{i}") for i in range(P)]
    sums = {"n": F.lit(float(WIDE_ROWS))} | {f"s_{i}": WIDE_ROWS * mu[i] for i in range(P)} | {f"s_{i}{j}": WIDE_ROWS * (mu[i] * mu[j] + F.lit((WIDE * GRID) ** 2 if i == j else 0.0)) for i in range(P) for j in range(i + 1)}
    return start.select("g", *[c.alias(n) for n, c in sums.items()])


def _concentrated(vectors: DataFrame, estimate: DataFrame, prior: DataFrame | None, coverage: float, steps: int) -> tuple[DataFrame, DataFrame]:
    """Estimates ``(g, mu_i, l_ij)`` after so many steps, and the sums they are of; sums of ``prior`` are added for each group."""
    axes = list(AXES)
    # a covariance of the nearest part is too small by this factor where the bulk is normal
    scale = coverage / chi_square_cdf(chi_square_quantile(coverage, P), P + 2)
    sums = {"n": F.count("*")} | {f"s_{i}": F.sum(a) for i, a in enumerate(axes)} | {f"s_{i}{j}": F.sum(F.col(axes[i]) * F.col(axes[j])) for i in range(P) for j in range(i + 1)}
    moments = prior
    for _ in range(steps):
        near = vectors.join(estimate.withColumnRenamed("g", "k_g"), F.col("q_group") == F.col("k_g"))
        binned = near.groupBy(F.col("q_group").alias("g"), F.floor(F.log1p(distance()) * BINS_PER_LOG).alias("bin")).agg(*[c.alias(n) for n, c in sums.items()])
        upto = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        binned = binned.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("g")))
        nearest = binned.where(F.col("before") < F.col("all") * coverage)
        moments = nearest.groupBy("g").agg(*[F.sum(n).alias(n) for n in sums])
        if prior is not None:
            own = moments.select("g", *[F.col(n).alias(f"own_{n}") for n in sums])
            moments = own.join(prior, "g").select("g", *[(F.col(f"own_{n}") + F.col(n)).alias(n) for n in sums])
        moments = staged(moments, "moments")
        estimate = staged(_estimate(moments, scale), "estimate")
    return estimate, moments


def fit(vectors: DataFrame, coverage: float = COVERAGE, steps: int = STEPS) -> DataFrame:
    """Estimates ``(g, mu_i, l_ij)`` for every ``q_group`` of ``vectors``, a written table, each by itself."""
    return _concentrated(vectors, _start(vectors), None, coverage, steps)[0]


def fit_levels(vectors: DataFrame, rows: int = MIN_ROWS, coverage: float = COVERAGE, steps: int = STEPS) -> DataFrame:
    """Estimates for every ``q_own`` of ``vectors``, drawn towards those of its ``q_wider``, and these towards that of all."""
    whole = vectors.select(F.lit("all").alias("q_group"), *AXES)
    start = _start(whole)
    estimate, moments = _concentrated(whole, start, _wide(start), coverage, steps)
    for level, above in (("q_wider", F.lit("all")), ("q_own", F.col("q_wider"))):
        here = vectors.select(F.col(level).alias("q_group"), *AXES)
        kin = vectors.select(F.col(level).alias("g"), above.alias("above")).distinct()
        share = F.lit(float(rows)) / F.col("n")
        prior = kin.join(moments.withColumnRenamed("g", "above"), "above").select("g", *[(F.col(n) * share).alias(n) for n in SUMS])
        # steps start from the wider estimate, so that what is most of a small group does not make its own
        begin = staged(kin.join(estimate.withColumnRenamed("g", "above"), "above").drop("above"), "estimate")
        estimate, moments = _concentrated(here, begin, staged(prior, "prior"), coverage, steps)
    return estimate


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_text: bool = True, min_rows: int = MIN_ROWS) -> DataFrame:
    """``docs`` with its counts, q_base_failed, q_distance (null where no estimate applies) and q_kept."""
    extra = [c for c in docs.columns if c not in ADDED and (keep_text or c != text_col)]
    packed = docs.select(F.struct(*extra).alias("q_row"), F.col(text_col).alias("q_text"), F.to_json(F.struct(F.col(lang_col).alias("lang"))).alias("q_wider"), F.to_json(F.struct(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))).alias("q_own"))
    counted = staged(statistics(packed, "q_text").drop("q_text"), "statistics")
    vectors = staged(counted.where(~F.col("q_base_failed")).select("q_own", "q_wider", *AXES), "vectors")
    far = counted.join(staged(fit_levels(vectors, min_rows), "estimate"), F.col("q_own") == F.col("g"), "left")
    far = far.withColumn("q_distance", distance()).withColumn("q_kept", ~F.col("q_base_failed") & (F.coalesce(F.col("q_distance"), F.lit(0.0)) <= chi_square_quantile(CONFIDENCE, P)))
    return far.select("q_row.*", *ADDED)
