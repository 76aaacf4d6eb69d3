"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Base rules reject a document with fewer than 20 words, or with over 30 % of its words in repeated 8-word windows. Of the
others four rates are measured: symbols per 1000 characters of words, repeated lines and repeated words per 1000, and the
mean word length in hundredths. A rate's sketch is a histogram of its values rounded down to their six leading binary
digits (relative error below 1/32). Histograms of several groups merge by adding counts, and each has a few hundred cells
however many documents it stands for. A document is kept while each of its rates lies within the fences of its (language,
source): the quartiles, widened by three times their distance and by a slack. A group of fewer than ``least`` documents
takes the merged sketch of its language, and a language of fewer the one of all.

Everything is expressed with DataFrame functions; no Python runs on the executors.

Defined cases: a null text is the empty text and fails the base rule; null language or source is a group of its own;
repeated rows each count and each return a row; an empty table gives an empty result; further columns are ignored, and
kept by ``keep_good`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastemill.llm.common import free_names, words_of
from tastemill.session import checkpointed

LEAST_WORDS = 20
REPEATED_PERCENT = 30
WINDOW = 8
DIGITS = 6
LEAST_GROUP = 100

#: Rate, slack above the upper fence, and slack below the lower fence (None: no lower fence).
RATES = {"symbols": (20, None), "lines": (350, None), "repeats": (280, None), "length": (100, 100)}


def features(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed (each with ``prefix``)."""
    work = free_names(docs, *(f"{prefix}__{x}" for x in ("text", "words", "lines", "hashes", "halves", "windows", "placed", "at")))
    body, words, lines, hashes, halves, windows, placed, at = work
    c = lambda name: F.col(f"`{name}`")
    out = docs.withColumn(body, F.coalesce(c(text), F.lit(""))).withColumns({
        words: words_of(c(body)),
        lines: F.filter(F.split(c(body), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    out = out.withColumn(hashes, F.transform(c(words), lambda x: F.xxhash64(x)))
    # A window is a pair of half windows; where no half occurs twice, no window does.
    half = WINDOW // 2
    steps = lambda a, width: F.sequence(F.lit(0), F.size(a) - width)
    out = out.withColumn(halves, F.when(F.size(c(hashes)) > WINDOW, F.transform(steps(c(hashes), half), lambda i: F.xxhash64(*(F.get(c(hashes), i + k) for k in range(half))))))
    out = out.withColumn(windows, F.when(F.size(F.array_distinct(c(halves))) < F.size(c(halves)), F.transform(steps(c(halves), half + 1), lambda i: F.xxhash64(F.get(c(halves), i), F.get(c(halves), i + half)))))
    # The few documents in which a window occurs twice: their windows in the order of their hashes, then the places of repeated ones.
    twice = F.size(F.array_distinct(c(windows))) < F.size(c(windows))
    out = out.withColumn(placed, F.when(twice, F.sort_array(F.transform(c(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i, step: F.get(c(placed), i + step)["h"].eqNullSafe(x["h"])
    repeated = F.filter(c(placed), lambda x, i: same(x, i, 1) | ((i > 0) & same(x, i, -1)))
    out = out.withColumn(at, F.when(c(placed).isNotNull(), F.sort_array(F.transform(repeated, lambda x: x["i"]))))
    covered = F.aggregate(
        c(at), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"],
    )
    measures = {
        "n_words": F.size(c(words)),
        "word_chars": F.aggregate(c(words), F.lit(0).cast("bigint"), lambda n, x: n + F.char_length(x)),
        "n_symbols": F.regexp_count(c(body), F.lit(r"[#*$%&|<>]")),
        "n_lines": F.size(c(lines)),
        "n_dup_lines": F.size(c(lines)) - F.size(F.array_distinct(c(lines))),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    # As rows of a one-row table: a filter on the results is then not worked into the expressions above, where it would repeat them.
    row = F.inline(F.array(F.struct(*(value.cast("bigint").alias(f"{prefix}{name}") for name, value in measures.items()))))
    return out.select(*(c(name) for name in docs.columns), row).withColumn(f"{prefix}base_failed", (c(f"{prefix}n_words") < LEAST_WORDS) | (100 * c(f"{prefix}n_repeat_words") > REPEATED_PERCENT * c(f"{prefix}n_words")))


def rates(prefix: str = "") -> dict[str, Column]:
    """The measured rates as whole numbers; null where there is nothing to measure."""
    c = lambda name: F.col(f"`{prefix}{name}`")
    share = lambda part, whole, per: F.when(c(whole) > 0, F.expr(f"`{prefix}{part}` * {per} div `{prefix}{whole}`"))
    return {"symbols": share("n_symbols", "word_chars", 1000), "lines": share("n_dup_lines", "n_lines", 1000), "repeats": share("n_repeat_words", "n_words", 1000), "length": share("word_chars", "n_words", 100)}


def rounded(value: Column) -> Column:
    """The value with all but its leading binary digits set to 0: the sketch cell it falls into."""
    scale = F.pow(F.lit(2), F.greatest(F.lit(0), F.length(F.bin(value)) - DIGITS)).cast("bigint")
    return value - F.pmod(value, scale)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rate, cell, n) of all documents that pass the base rules."""
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, RATES)), F.array(*(rates()[r] for r in RATES)))).alias("rate", "value")
    rows = measured.where(~F.col("base_failed")).select("lang", "source", pairs).where(F.col("value").isNotNull())
    return rows.groupBy("lang", "source", "rate", rounded(F.col("value")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(cells: DataFrame, by: list[str]) -> DataFrame:
    """Sketches merged over all other columns, and their size and quartiles."""
    merged = cells.groupBy(*by, "rate", "cell").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rate")
    ranked = merged.withColumns({"below": F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(group)})
    at = lambda q: F.min(F.when(F.col("below") * 4 >= F.col("total") * q, F.col("cell")))
    return ranked.groupBy(*by, "rate").agg(F.max("total").alias("total"), at(1).alias("low"), at(3).alias("high"))


def fences(cells: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """One row per (lang, source) of the sketches, with the bounds of each rate as {rate}_min and {rate}_max."""
    levels = [(0, ["lang", "source"]), (1, ["lang"]), (2, [])]
    groups = cells.select("lang", "source").distinct()
    found = None
    for level, by in levels:
        stats = quartiles(cells, by).withColumn("level", F.lit(level))
        known = groups.join(stats.withColumnsRenamed({k: f"of_{k}" for k in by}), [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in by] or F.lit(True)) if by else groups.join(F.broadcast(stats))
        known = known.select("lang", "source", "rate", "level", "total", "low", "high")
        found = known if found is None else found.unionByName(known)
    big = (F.col("total") >= least) | (F.col("level") == 2)
    chosen = found.where(big).groupBy("lang", "source", "rate").agg(F.min_by(F.struct("low", "high"), "level").alias("q"))
    spread = 3 * (F.col("q.high") - F.col("q.low"))
    bound = lambda rate, which: F.max(F.when(F.col("rate") == rate, F.col("q.high") + spread + RATES[rate][0] if which == "max" else F.col("q.low") - spread - RATES[rate][1]))
    return chosen.groupBy("lang", "source").agg(*(bound(r, w).alias(f"{r}_{w}") for r in RATES for w in ("min", "max") if w == "max" or RATES[r][1] is not None))


def judged(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """``measured`` with the column ``{prefix}kept``. The limits are one row per group, read from a stored table, so that
    the optimizer broadcasts them only while their size allows."""
    names = free_names(measured, *limits.columns)
    limits = limits.withColumnsRenamed(dict(zip(limits.columns, names, strict=True)))
    at = dict(zip(["lang", "source", *(f"{r}_{w}" for r in RATES for w in ("min", "max") if w == "max" or RATES[r][1] is not None)], names, strict=True))
    inside = F.lit(True)
    for rate, value in rates(prefix).items():
        for which in ("min", "max"):
            if name := at.get(f"{rate}_{which}"):
                edge = F.col(f"`{name}`")
                inside &= F.coalesce((value >= edge) if which == "min" else (value <= edge), F.lit(True))
    c = lambda name: F.col(f"`{name}`")
    joined = measured.join(limits, c(lang).eqNullSafe(c(at["lang"])) & c(source).eqNullSafe(c(at["source"])), "left")
    return joined.withColumn(f"{prefix}kept", ~c(f"{prefix}base_failed") & inside).drop(*names)


def assess(docs: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document. The counts are stored once; sketches and verdicts
    both read them."""
    measured = checkpointed(features(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    limits = checkpointed(fences(sketches(measured), least))
    return judged(measured, limits)


def keep_good(docs: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """The documents that pass, with all their columns. Texts are measured a second time instead of being shuffled."""
    limits = checkpointed(fences(sketches(features(docs.select("text", "lang", "source"))), least))
    mark = free_names(docs, "_q_")[0]
    while any(c.lower().startswith(mark.lower()) for c in docs.columns):
        mark = f"_{mark}"
    passed = judged(features(docs, prefix=mark), limits, prefix=mark).where(F.col(f"`{mark}kept`"))
    return passed.select(*(F.col(f"`{c}`") for c in docs.columns))
