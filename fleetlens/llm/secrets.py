"""Secret scan with an incremental ledger of blobs (built-in functions only).

Every version of a text is a blob, addressed by the SHA-256 of its content; many paths can hold one
blob.  A ledger says which rule versions have seen which blob.  Only unseen pairs of
blob and rule version are scanned, each blob once, and findings are joined back to all
paths that hold the blob.  A changed rule has another version (a hash of its pattern), so
the next run scans all blobs for that rule alone.

A stored ledger is a folder of rows, one for each blob a run has scanned: the rule versions applied and
what they found, none included.  A run (``advance``) adds its rows by one write, so a run that is lost adds nothing and
is made again; rows that two runs add alike count once.

Texts are shuffled once, by address, after equal ones are reduced in each task, so a blob that
a third of the paths hold is one row a task.  Places are running sums over a blob's matches,
computed in the same partitions.  Only addresses go through the join back, where a common blob is a hot
key of a plain join that Spark splits.

Defined results: a null text is the empty blob, without findings; a null path is kept; equal rows
all get their findings; empty tables give empty results; input columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import add, any_names, column, saved, unused


class Rule(NamedTuple):
    kind: str
    pattern: str       # matched from the left, without overlaps
    group: int = 0     # a match counts if this group ...
    least: int = 1     # ... has so many characters
    gate: str | None = None  # cheaper pattern that every text with a counting match has

    @property
    def version(self) -> str:
        return hashlib.md5(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


#: a row of a stored ledger
LEDGER = {"blob": "string", "versions": "array<string>", "found": "array<struct<kind:string,version:string,start:bigint,end:bigint>>"}
_B, _E = r"(?<![A-Za-z0-9_-])", r"(?![A-Za-z0-9_-])"
#: Base kinds first, in the order in which equal starts are listed; the others are the method's own.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12,
         r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", gate="PRIVATE KEY"),
    Rule("github", _B + r"(?:gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{60,}+)" + _E, gate="gh[pousr]_|github_pat_"),
    Rule("slack", _B + r"xox[abeoprs]-[A-Za-z0-9-]{10,}+", gate="xox[abeoprs]-"),
    Rule("google", _B + r"AIza[A-Za-z0-9_-]{35}" + _E, gate="AIza"),
    Rule("stripe", _B + r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}+" + _E, gate="k_live_|k_test_"),
    Rule("jwt", _B + r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", gate="eyJ"),
    Rule("url_login", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]++://[^\s/:@]++:[^\s/:@]{3,}+@", gate="://"),
)


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _places(text: Column, rule: Rule) -> Column:
    """For each match: characters since the last match, its length, and that of the group that counts."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counts = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    # the piece after the last match has no match beside it: zipped with null, dropped below
    return F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
                        F.transform(found, F.length).alias("size"), F.transform(counts, F.length).alias("counts"))


def unseen(docs: DataFrame, text: str, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, text, versions``: each blob once, with the rule versions that have not seen it."""
    versions = F.array(*[F.lit(r.version) for r in rules])
    blobs = docs.select(address(column(docs, text)).alias("blob"), F.coalesce(column(docs, text), F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        return blobs.withColumn("versions", versions)
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("versions")).alias("seen"))  # a row for each run that scanned the blob
    out = blobs.join(seen, "blob", "left").withColumn("versions", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>"))))
    return out.where(F.size("versions") > 0).select("blob", "text", "versions")


def recorded(new: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``new`` scanned, as rows of a ledger: ``blob, versions, found`` (places in code points, end exclusive)."""
    kinds = []
    for n, rule in enumerate(rules):
        wanted = F.array_contains("versions", rule.version) & F.col("text").rlike(rule.gate or rule.pattern)
        rows = F.transform(_places(F.col("text"), rule), lambda m, i: F.struct(
            F.lit(n).alias("rule"), i.alias("i"), m["gap"].alias("gap"), m["size"].alias("size"), m["counts"].alias("counts")))
        kinds.append(F.when(wanted, F.filter(rows, lambda m: m["size"].isNotNull())))
    found = new.select("blob", "versions", F.explode_outer(F.flatten(F.filter(F.array(*kinds), lambda a: a.isNotNull()))).alias("m")) \
        .select("blob", "versions", "m.*")
    up_to = "sum(gap + size) OVER (PARTITION BY blob, rule ORDER BY i)"
    found = found.withColumn("end", F.expr(up_to)).withColumn("start", F.col("end") - F.col("size"))
    least = F.array(*[F.lit(r.least) for r in rules])
    kind, version = (F.array(*[F.lit(x) for x in v]) for v in ([r.kind for r in rules], [r.version for r in rules]))
    one = F.struct(kind[F.col("rule")].alias("kind"), version[F.col("rule")].alias("version"), "start", "end")
    out = found.groupBy("blob").agg(F.first("versions").alias("versions"),  # the same in all rows of a blob
                                    F.collect_list(F.when(F.col("counts") >= least[F.col("rule")], one)).alias("found"))
    return out.select(*[F.col(n).cast(t).alias(n) for n, t in LEDGER.items()])


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, kind, rule, version, start, end``: what a ledger holds of these rules (``rule`` is the place in their list)."""
    versions = F.array(*[F.lit(r.version) for r in rules])
    found = ledger.select("blob", F.explode("found").alias("f")).select("blob", "f.*").withColumn("rule", F.array_position(versions, F.col("version")).cast("int") - 1)
    return found.where("rule >= 0").select("blob", "kind", "rule", "version", "start", "end")


def scan(new: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings in ``new``, without a stored ledger."""
    return findings(recorded(new, rules), rules)


def seen_pairs(new: DataFrame) -> DataFrame:
    """``blob, versions`` to add to the ledger once the findings are stored."""
    return new.select("blob", "versions")


def open_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger stored in a (shared) folder, begun where there is none."""
    spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in LEDGER.items()]).write.mode("ignore").parquet(folder)
    return spark.read.schema(", ".join(f"{n} {t}" for n, t in LEDGER.items())).parquet(folder)


def advance(docs: DataFrame, text: str, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One run over ``docs``: scans the pairs of blob and rule version that the stored ledger has not seen, and adds them.

    Returns the ledger after it, for ``findings`` and ``report``."""
    ledger = open_ledger(docs.sparkSession, folder)
    recorded(unseen(docs, text, ledger, rules), rules).write.mode("append").parquet(folder)
    return open_ledger(docs.sparkSession, folder)


def by_blob(findings: DataFrame) -> DataFrame:
    """``blob, found``: a blob's findings in order of start, then kind."""
    one = F.struct("start", "rule", "end", "kind")
    return findings.groupBy("blob").agg(F.array_sort(F.collect_set(one)).alias("found"))


@any_names
def report(docs: DataFrame, text: str, findings: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep``) with ``blob`` and ``found`` (array of start, rule, end, kind)."""
    b, f = unused(docs, "blob", "blobfound")
    paths = docs.withColumn(b, address(docs[text])).select(*(docs.columns if keep is None else keep), b)
    # kept apart, so that both sides of the join are dealt out for it and a common blob's paths can be split
    rows = saved(by_blob(findings)).select(F.col("blob").alias(b), F.col("found").alias(f))
    out = paths.join(rows, b, "left")
    none = F.array().cast(rows.schema[f].dataType)
    return add(out, blob=out[b], found=F.coalesce(out[f], none)).drop(b, f)
