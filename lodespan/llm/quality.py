"""Quality rules as robust multivariate outliers, with DataFrame functions only.

Each document gives a vector of transformed statistics (`FEATURES`). For every language and source the minimum
covariance determinant estimates the centre and spread of the bulk. From each of several starts concentration steps fit
mean and covariance to the `BULK` nearest rows and take the nearest rows anew, until no group's determinant changes;
of a group's results that with the least determinant counts. Documents whose Mahalanobis distance under it exceeds
`CUTOFF` are rejected; where the median distance is above that of a normal sample, distances are scaled down to it.

A step reads the small table of vectors twice: for a histogram of distances per group and start, whose bin edge bounds the
bulk, and for the moments of the bulk. Both are partial aggregates, so a group with a third of all rows is no burden. Groups
with fewer than MIN_GROUP rows are pooled by language, what is left then into one group. A larger group's verdicts depend
on its own rows only. The estimates are written tables joined by group: the planner sees their size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespan.session import cut

WINDOW = 8
#: Share of a group's rows that the estimate fits, smallest group with an estimate of its own, most concentration steps
#: (their determinants fall; some groups move between two bins of distances for ever), and the change that ends them.
BULK, MIN_GROUP, MOST_STEPS, SETTLED = 0.75, 30, 12, 0.01
#: Squared distance beyond which a document of a very large group is rejected: the 1 - 1e-6 quantile of chi-squared with 5
#: degrees of freedom. Documents have longer tails than normal rows, so more of them lie beyond it.
CUTOFF = 35.89
#: In a group of n rows CUTOFF grows by SMALL / (n - 5) of itself: about what Hotelling's statistic has over chi-squared.
SMALL = 45.0
#: Median of chi-squared with 5 degrees of freedom.
MEDIAN = 4.3515
#: Fewest words, and most repeated words in a hundred, of the base rules.
MIN_WORDS, MOST_REPEATED = 20, 30

_BLANK = " \t\n\x0b\x0c\r"
_SPACE = "[\\x20\\x09-\\x0D]+"

#: Names of the vector's coordinates with their smallest spread: coordinates that are 0 for most documents have none.
FEATURES = {"size": 1.0, "length": 0.5, "symbols": 0.05, "lines": 0.15, "repeats": 0.15}


def _windows(hashes: Column, size: Column) -> Column:
    """Hashes of all runs of WINDOW words, by their first word's position."""
    whole = F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))
    return F.when(size >= WINDOW, whole).otherwise(F.array().cast("array<bigint>"))


def _covered(starts: Column) -> Column:
    """Words that the windows at these sorted positions cover."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))
    step = lambda acc, at: F.struct((acc["n"] + at + WINDOW - F.greatest(at, acc["end"])).alias("n"), (at + WINDOW).cast("int").alias("end"))
    return F.aggregate(starts, zero, step)["n"]


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df without text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (long) of the whole text.

    Null and empty texts have no words and one line. Other columns pass through.
    """
    names = [c for c in df.columns if c != text]
    content = F.coalesce(F.col(text), F.lit(""))
    inner = F.trim(content, F.lit(_BLANK))
    worded = F.filter(F.split(content, "\n", -1), lambda line: F.trim(line, F.lit(_BLANK)) != "")
    first = df.select(
        *names,
        F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SPACE, -1)).alias("_words"),
        F.regexp_count(content, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        worded.alias("_worded"),
        (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
    )
    second = first.select(
        *names, "n_symbols", "n_lines",
        F.size("_words").alias("_n"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    third = second.select(*names, "n_symbols", "n_lines", "_n", "word_chars", "n_dup_lines", _windows(F.col("_hashes"), F.col("_n")).alias("_grams"))
    repeated = F.size(F.array_distinct("_grams")) < F.size("_grams")
    ranked = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    fourth = third.select(*names, "n_symbols", "n_lines", "_n", "word_chars", "n_dup_lines", F.when(repeated, ranked).alias("_ranked"))
    sorted_, last = F.col("_ranked"), F.size("_ranked") - 1
    twin = lambda j: ((j > 0) & (sorted_[F.greatest(j - 1, F.lit(0))]["h"] == sorted_[j]["h"])) | ((j < last) & (sorted_[F.least(j + 1, last)]["h"] == sorted_[j]["h"]))
    starts = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda j: sorted_[j]["i"]))
    return fourth.select(
        *names,
        F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.when(sorted_.isNull(), F.lit(0).cast("long")).otherwise(_covered(starts)).alias("n_repeat_words"),
        "n_lines",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _vector(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return df.select(
        "*",
        F.log1p(F.col("n_words").cast("double")).alias("size"),
        (F.col("word_chars") / words).alias("length"),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("symbols"),
        F.sqrt(F.col("n_dup_lines") / F.col("n_lines")).alias("lines"),
        F.sqrt(F.col("n_repeat_words") / words).alias("repeats"),
    )


def _named(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("-"))


def _grouped(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """rows with the column group: language and source if it has rows enough, else the language's rest, else '*'."""
    own, tongue = F.concat_ws("/", _named(lang), _named(source)), _named(lang)
    counts = cut(rows.groupBy(own.alias("own"), tongue.alias("tongue")).agg(F.count(F.lit(1)).alias("n")), "groups")
    large = cut(counts.where(F.col("n") >= MIN_GROUP).select(F.col("own").alias("group")), "large")
    placed = rows.withColumns({"_own": own, "_tongue": tongue}).join(large, F.col("_own") == F.col("group"), "left").withColumnRenamed("group", "_large")
    rest = counts.join(large, F.col("own") == F.col("group"), "left_anti").groupBy("tongue").agg(F.sum("n").alias("n"))
    pooled = cut(rest.where(F.col("n") >= MIN_GROUP).select(F.col("tongue").alias("group")), "pooled")
    placed = placed.join(pooled, F.col("_tongue") == F.col("group"), "left")
    return placed.withColumn("group", F.coalesce("_large", "group", F.lit("*"))).drop("_own", "_tongue", "_large")


def _quantile(values: DataFrame, keys: list[str], bin_: str, share: float) -> DataFrame:
    """keys and the first bin at which a share of the rows of (keys, bin_) is reached."""
    counts = values.groupBy(*keys, bin_).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*keys).orderBy(bin_)
    reached = F.sum("n").over(up) >= share * F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("reached", reached).where("reached").groupBy(*keys).agg(F.min(bin_).alias(bin_))


#: Bins of a squared distance: 32 for each doubling. Of a coordinate: 1024 for each unit.
_FINE, _GRID = 32, 1024


def _bin(distance: Column) -> Column:
    return F.ceil(F.log2(F.greatest(distance, F.lit(1e-6))) * _FINE)


def _edge(bin_: Column) -> Column:
    return F.pow(F.lit(2.0), bin_ / _FINE)


def _median(rows: DataFrame, names: list[str], made: str) -> DataFrame:
    """(group, made): the array of the medians of the columns names, on a grid."""
    one = rows.select("group", F.posexplode(F.array(*(F.round(F.col(n) * _GRID).cast("long") for n in names))).alias("k", "bin"))
    middle = _quantile(one, ["group", "k"], "bin", 0.5)
    return middle.groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "bin"))), lambda x: x["bin"] / _GRID).alias(made))


def _starts(rows: DataFrame) -> DataFrame:
    """(group, start, centre, precision, volume): medians with median absolute deviations, medians with the smallest
    spreads, and the mean and covariance of all rows."""
    names, size = list(FEATURES), len(FEATURES)
    centre = cut(_median(rows, names, "centre"), "centre")
    off = rows.join(centre, "group").select("group", *(F.abs(F.col(n) - F.col("centre")[i]).alias(n) for i, n in enumerate(names)))
    spread = _median(off, names, "spread")
    floors = F.array(*(F.lit(f) for f in FEATURES.values()))
    scaled = F.zip_with("spread", floors, lambda s, f: F.lit(1.0) / (F.lit(1.4826 * 1.4826) * s * s + f * f))
    zero = F.lit(0.0)
    diagonal = lambda c: F.array(*(F.array(*(c[i] if i == j else zero for j in range(size))) for i in range(size)))
    first = centre.join(cut(spread.select("group", scaled.alias("inverse")), "spread"), "group").select("group", F.lit(0).alias("start"), "centre", diagonal(F.col("inverse")).alias("precision"), F.lit(0.0).alias("volume"))
    second = centre.select("group", F.lit(1).alias("start"), "centre", diagonal(F.transform(floors, lambda f: 1.0 / (f * f))).alias("precision"), F.lit(0.0).alias("volume"))
    third = _inverted(_moments(rows.withColumn("start", F.lit(2))))
    return cut(first.unionByName(second).unionByName(third), "estimate")


def _moments(rows: DataFrame) -> DataFrame:
    """Means m<i> and covariances c<i>_<j> of each group and start."""
    names = list(FEATURES)
    return cut(rows.groupBy("group", "start").agg(
        *(F.avg(n).alias(f"m{i}") for i, n in enumerate(names)),
        *(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for j in range(len(names)) for i in range(j, len(names))),
    ), "moments")


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its group's centre and precision."""
    names = list(FEATURES)
    off = [F.col(n) - F.col("centre")[i] for i, n in enumerate(names)]
    terms = [(1 if i == j else 2) * F.col("precision")[i][j] * off[i] * off[j] for i in range(len(names)) for j in range(i + 1)]
    return reduce(lambda a, b: a + b, terms)


def _inverted(moments: DataFrame) -> DataFrame:
    """(group, start, centre, precision, volume) from moments, floors added, by Cholesky decomposition; volume is the
    logarithm of the determinant."""
    size, floors = len(FEATURES), list(FEATURES.values())
    low, df = {}, moments
    for j in range(size):
        for i in range(j, size):
            rest = F.col(f"c{i}_{j}") + (floors[j] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            low[i, j] = f"l{i}_{j}"
            df = df.withColumn(low[i, j], F.sqrt(rest) if i == j else rest / F.col(f"l{j}_{j}"))
    for j in range(size):  # the inverse of the lower triangle
        for i in range(j, size):
            if i == j:
                value = 1.0 / F.col(f"l{i}_{i}")
            else:
                value = -reduce(lambda a, b: a + b, [F.col(f"l{i}_{k}") * F.col(f"v{k}_{j}") for k in range(j, i)]) / F.col(f"l{i}_{i}")
            df = df.withColumn(f"v{i}_{j}", value)
    entry = lambda i, j: reduce(lambda a, b: a + b, [F.col(f"v{k}_{i}") * F.col(f"v{k}_{j}") for k in range(max(i, j), size)])
    volume = 2 * reduce(lambda a, b: a + b, [F.log(f"l{i}_{i}") for i in range(size)])
    return df.select("group", "start", volume.alias("volume"), F.array(*(f"m{i}" for i in range(size))).alias("centre"), F.array(*(F.array(*(entry(i, j) for j in range(size))) for i in range(size))).alias("precision"))


def concentrate(rows: DataFrame, now: DataFrame, bulk: float = BULK) -> DataFrame:
    """A concentration step from the estimates now: those of the bulk nearest to each."""
    names = list(FEATURES)
    far = rows.join(now, "group").select("group", "start", *names, _bin(_distance()).alias("bin"))
    edge = cut(_quantile(far, ["group", "start"], "bin", bulk).withColumnRenamed("bin", "edge"), "edge")
    return cut(_inverted(_moments(far.join(edge, ["group", "start"]).where("bin <= edge"))), "estimate")


def estimates(rows: DataFrame, steps: int = MOST_STEPS, bulk: float = BULK) -> DataFrame:
    """(group, start, centre, precision, volume, scale, fitted) from rows of (group, *FEATURES): of each group the start with
    the least determinant, its bulk's mean and inverse covariance, the factor that brings the median squared distance to
    MEDIAN, and the group's number of rows."""
    now = _starts(rows)
    for step in range(steps):
        before, now = now, concentrate(rows, now, bulk)
        moved = now.join(before.select("group", "start", F.col("volume").alias("old")), ["group", "start"])
        if step and (moved.agg(F.max(F.abs(F.col("volume") - F.col("old")))).first()[0] or 0.0) < SETTLED:
            break
    best = now.groupBy("group").agg(F.min_by(F.struct("start", "centre", "precision", "volume"), F.struct("volume", "start")).alias("best"))
    now = cut(best.select("group", "best.*"), "best")
    far = rows.join(now, "group").select("group", _bin(_distance()).alias("bin"))
    middle = cut(_quantile(far, ["group"], "bin", 0.5).select("group", (_edge(F.col("bin")) / MEDIAN).alias("scale")), "scale")
    counted = cut(rows.groupBy("group").agg(F.count(F.lit(1)).alias("fitted")), "fitted")
    return cut(now.join(middle, "group").join(counted, "group"), "estimates")


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each row of df: key, the statistics, base_failed, kept, group and distance (squared, scaled).

    Documents that fail the base rules take no part in the estimates and are not kept. Those of groups with fewer than
    MIN_GROUP such rows, pooled or not, are kept. Null languages and sources are values of their own; null and empty texts fail the base
    rules; very long texts are read whole. Ties and repeated rows count each; an empty table gives an empty result. Columns other than these four are
    left out.
    """
    rows = cut(statistics(df.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))), "statistics")
    grouped = cut(_grouped(_vector(rows).withColumn("base_failed", base_failed()), "lang", "source"), "vectors")
    fit = estimates(grouped.where("not base_failed").select("group", *FEATURES))
    joined = grouped.join(fit, "group", "left")
    distance = F.when(F.col("fitted") >= MIN_GROUP, _distance() / F.greatest(F.col("scale"), F.lit(1.0)))
    judged = joined.withColumn("distance", distance)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF * (1 + SMALL / (F.col("fitted") - len(FEATURES))), F.lit(True))
    return judged.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "group", "distance")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of each row of documents, with group and distance."""
    return judge(df)
