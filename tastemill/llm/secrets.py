"""Secret scans with an incremental ledger of content-addressed blobs.

A blob is the SHA-256 of a text. Each path (a document, or any historical version of it) points to one. The ledger notes
which (blob, rule, version) pairs have been scanned and what was found; a scan reads only pairs that are not there, one
representative row per blob, and its findings are joined back to all paths. Without a ledger folder every blob is unseen.

Places of matches come from the same pattern used twice: ``split`` gives the gaps, ``regexp_extract_all`` the matches, and
running sums of both lengths are the starts, in code points. All of it is DataFrame functions; no Python runs on the executors.

Defined cases: a null text is the empty text; rows that repeat a path or a text each get the findings; a null path is kept;
an empty table gives an empty result; further columns are ignored, and kept by ``redact`` whatever their names. A scan that
is repeated after a failure under the same ``run`` replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tastemill.llm.common import free_names
from tastemill.session import checkpointed


@dataclass(frozen=True)
class Rule:
    """A pattern in Java's syntax. Matches are leftmost and do not overlap; those whose ``group`` is shorter than ``least`` code points are dropped
    afterwards, so they still use up the text they cover."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: Base rules, in the order that breaks ties between equal starts; then the rules this engine adds.
BASE_RULES = (
    Rule("assign", 1, r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}"),  # a run is matched whole, so asking for 32 here is the same as dropping shorter runs
)
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES


def blob_of(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule] = RULES, todo: str | None = None) -> DataFrame:
    """(blob, rule, version, start, end) of all matches in (blob, text) rows. With ``todo``, an array column of rule names, only those are tried."""
    text = F.col("text")
    found = []
    for k, rule in enumerate(rules):
        whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
        wanted = text.rlike(rule.pattern)
        if todo:
            wanted = F.array_contains(todo, f"{rule.name}:{rule.version}") & wanted
        measured = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        lengths = lambda a: F.transform(a, lambda x: F.char_length(x))
        found.append(F.when(wanted, F.struct(F.lit(k).alias("k"), lengths(F.split(text, rule.pattern, -1)).alias("gaps"), lengths(whole).alias("sizes"), lengths(measured).alias("measured"))))
    hits = F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("hit")
    places = blobs.select("blob", hits).select("blob", F.col("hit.k").alias("k"), F.posexplode(F.arrays_zip("hit.gaps", "hit.sizes", "hit.measured")).alias("i", "m"))
    places = places.where(F.col("m.sizes").isNotNull())
    # A blob may come twice when its rows repeat; the matches of one text are summed in one place.
    once = places.repartition("blob", "k").dropDuplicates(["blob", "k", "i"])
    upto = Window.partitionBy("blob", "k").orderBy("i")
    end = F.sum(F.col("m.gaps") + F.col("m.sizes")).over(upto)
    named = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least")) for r in rules))
    rows = once.select("blob", F.get(named, F.col("k")).alias("r"), "m", end.alias("end"))
    rows = rows.where(F.col("m.measured") >= F.col("r.least"))
    return rows.select("blob", F.col("r.rule").alias("rule"), F.col("r.version").alias("version"), (F.col("end") - F.col("m.sizes")).alias("start"), "end")


def scan(paths: DataFrame, rules: Sequence[Rule] = RULES, ledger: str | None = None, run: str = "0") -> tuple[DataFrame, DataFrame]:
    """Scan the (path, text) rows. Returns (path, blob) and the findings of all rules' present versions, old and new.

    ``ledger`` is a folder with the tables ``scanned`` and ``findings``; this scan adds to both under ``run``.
    """
    spark = paths.sparkSession
    versions = paths.select("path", "text", blob_of(F.col("text")).alias("blob"))
    known = checkpointed(versions.select("path", "blob"))
    chosen = known.groupBy("blob").agg(F.min("path").alias("first_path"))
    pairs = F.array(*(F.lit(f"{r.name}:{r.version}") for r in rules))
    if ledger:
        scanned_type, findings_type = "blob binary, rule string, version int, run string", "blob binary, rule string, version int, start bigint, end bigint, run string"
        old = _stored(spark, f"{ledger}/scanned", scanned_type)
        done = old.where(F.col("run") != run).groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("done"))
        chosen = chosen.join(done, "blob", "left").withColumn("todo", F.array_except(pairs, F.coalesce("done", F.array().cast("array<string>")))).drop("done").where(F.size("todo") > 0)
        chosen = checkpointed(chosen)
    side = chosen.withColumnsRenamed({"blob": "of_blob"}).hint("shuffle_hash")
    unseen = versions.join(side, (F.col("blob") == F.col("of_blob")) & F.col("path").eqNullSafe(F.col("first_path")))
    new = scan_blobs(unseen, rules, "todo" if ledger else None)
    if not ledger:
        return known, new
    new.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{ledger}/findings")
    noted = chosen.select("blob", F.explode("todo").alias("pair")).select("blob", F.substring_index("pair", ":", 1).alias("rule"), F.substring_index("pair", ":", -1).cast("int").alias("version"), F.lit(run).alias("run"))
    noted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{ledger}/scanned")
    wanted = F.concat_ws(":", "rule", "version").isin([f"{r.name}:{r.version}" for r in rules])
    findings = spark.read.schema(findings_type).parquet(f"{ledger}/findings").where(wanted)
    # A run that was stopped between the two writes has left findings whose pairs the next one scans again: each counts once.
    findings = findings.select("blob", "rule", "version", "start", "end").distinct()
    return known, findings.join(known.select("blob").distinct(), "blob", "left_semi")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the ledger; empty before the first scan."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def digests(findings: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES) -> DataFrame:
    """Per blob: the number of spans of each base rule, the digest of the base spans, and all spans as text."""
    order = F.element_at(F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k)))), F.col("rule"))
    spans = F.array_sort(F.collect_list(F.struct("start", order.alias("k"), "end", "rule")))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
    counts = [F.count_if(F.col("rule") == r.name).cast("bigint").alias(f"n_{r.name}") for r in base]
    return findings.groupBy("blob").agg(*counts, spans.alias("all")).select(
        "blob", *(f"n_{r.name}" for r in base), F.sha2(joined(F.filter("all", lambda s: s["k"] < len(base))), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def report(docs: DataFrame, rules: Sequence[Rule] = RULES, ledger: str | None = None, run: str = "0") -> DataFrame:
    """doc_id and the digests of its text, one row per row of ``docs``."""
    known, findings = scan(docs.select(F.col("doc_id").alias("path"), "text"), rules, ledger, run)
    counts = [f"n_{r.name}" for r in BASE_RULES]
    out = known.join(digests(findings, rules), "blob", "left")
    empty = F.sha2(F.lit(""), 256)
    return out.select(F.col("path").alias("doc_id"), *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts), F.coalesce("base_sha256", empty).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mask: str = "[secret]") -> DataFrame:
    """All documents, with every text that holds secrets replaced by one in which each (merged) span is ``mask``."""
    # The digests of clean texts are not shuffled: only blobs with findings have a row to join.
    _, findings = scan(docs.select(F.col("doc_id").alias("path"), "text"), rules)
    spans = checkpointed(findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")))
    blob, of, cut = free_names(docs, "blob", "of_blob", "spans")
    c = lambda name: F.col(f"`{name}`")
    marked = docs.withColumn(blob, blob_of(c("text"))).join(spans.select(F.col("blob").alias(of), F.col("spans").alias(cut)), c(blob) == c(of), "left")
    step = lambda a, s: F.struct(
        F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(F.substring(c("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mask))).otherwise("")).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"))
    clean = F.aggregate(c(cut), F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")), step, lambda a: F.concat(a["out"], F.substring(c("text"), (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return marked.withColumn("text", F.when(c(cut).isNull(), c("text")).otherwise(clean)).select(*(c(name) for name in docs.columns))
