"""Secret scanning with an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content. The ledger, a Parquet table, says which (blob, rule
version) pairs have been scanned and what was found. A run scans only pairs that the ledger lacks, each blob once however
many paths hold it, appends what it learns, and joins findings back to all paths. Contents move through one shuffle by
path; equal contents are never gathered.

Spans are code points, end exclusive. Null content counts as empty; repeated rows are answered each; a null path is a
path like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hashed, shuffles_freed

SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Matches that one list is appended to.
RUN = 64


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose group is shorter than least are dropped. Raise the version when a rule changes."""

    kind: str
    rank: int
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules. Where a run of one class must have n characters, {n,} finds what dropping shorter runs would.
BASE_RULES = (
    Rule("assign", 0, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=1, least=6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 2, r"[0-9a-f]{24,}"),
)
RULES = (*BASE_RULES, Rule("pem", 3, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"))


def _walked(parts: Column, at: Column, rule: Rule) -> Column:
    """Where a walk over parts from a position ends, and the spans of what it passes."""

    def step(so_far, part):
        start = so_far["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(rule.rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))).cast(SPANS)
        return F.struct(end.alias("at"), F.when(F.length(part["value"]) >= rule.least, F.concat(so_far["out"], one)).otherwise(so_far["out"]).alias("out"))

    return F.aggregate(parts, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), step)


def spans_of(text: Column, rule: Rule) -> Column:
    """All spans of a rule, by walking what lies between matches and the matches side by side.

    Appending to a list copies it, so the walk goes in runs of RUN matches: lengths of runs first, their starts by a running
    sum, and then each run by itself. A million matches in a text cost some hundred million copies of small numbers.
    """
    p = F.lit(rule.pattern)
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(rule.group)).alias("value"))
    length = lambda run: F.aggregate(run, F.lit(0), lambda n, part: n + F.length(part["gap"]) + F.coalesce(F.length(part["hit"]), F.lit(0)))
    starts = lambda sizes: F.aggregate(sizes, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
    # an array of one, transformed, gives a value a name: it is computed once
    cut_up = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda i: F.slice(all_, i * RUN + 1, F.lit(RUN)))
    runs = F.flatten(F.transform(F.array(parts), cut_up))
    begun = lambda rs: F.zip_with(rs, F.slice(starts(F.transform(rs, length)), F.lit(1), F.size(rs)), lambda run, at: _walked(run, at, rule)["out"])
    spans = F.flatten(F.flatten(F.transform(F.array(runs), begun)))
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(SPANS))


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(f"blob string, rule string, spans {SPANS}").parquet(path)


def scan(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """One row per version: path, blob, spans (all rules, by start and rank). Appends to the ledger at ledger_path."""
    spark = versions.sparkSession
    rows = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", F.sha2(F.col("text"), 256))
    addresses = cut(rows.select("path", "blob"), "addresses")
    blobs = addresses.groupBy("blob").agg(F.min("path").alias("path"))
    pairs = blobs.select("blob", "path", F.explode(F.array(*[F.lit(r.key) for r in rules])).alias("rule"))
    known = _ledger(spark, ledger_path)
    if known is not None:
        pairs = pairs.join(known.select("blob", "rule"), ["blob", "rule"], "left_anti")
        todo = pairs.groupBy("blob", "path").agg(F.collect_set("rule").alias("todo"))
    else:
        todo = blobs.select("blob", "path", F.array(*[F.lit(r.key) for r in rules]).alias("todo"))
    todo = todo.select(F.col("blob").alias("b"), F.col("path").alias("p"), "todo")
    texts = rows.join(hashed(todo, addresses.count()), F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")))
    found = texts.select("blob", *[F.when(F.array_contains("todo", r.key), spans_of(F.col("text"), r)).alias(r.key) for r in rules])
    found = found.select("blob", F.explode(F.array(*[F.struct(F.lit(r.key).alias("rule"), F.col(f"`{r.key}`").alias("spans")) for r in rules])).alias("x")).select("blob", "x.rule", "x.spans").where("spans is not null")
    with shuffles_freed(spark):
        found.write.mode("append").option("compression", "zstd").parquet(ledger_path)
    now = _ledger(spark, ledger_path).where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    findings = cut(now.groupBy("blob").agg(F.flatten(F.collect_set("spans")).alias("spans")), "findings")
    return addresses.join(findings, "blob", "left").select("path", "blob", F.sort_array(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
