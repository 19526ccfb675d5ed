"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. A ledger row says that one blob was scanned
under one rule version, and what was found. Only (blob, rule version) pairs that the ledger lacks are scanned, each blob
once however many paths and versions hold it; findings then go back to all paths by a join on the blob.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import find_spans, materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the pattern, the capture group that is measured, and its least length."""

    kind: str
    pattern: str
    group: int
    least: int


# The patterns are the contract's. Runs that are dropped when short are matched with their least length at once.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Kinds beyond the contract's: private keys' first lines, signed web tokens, prefixed service tokens, passwords in addresses.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 0, 1),
    Rule("prefixed", r"(gh[opsu]_[A-Za-z0-9]{30,}|xox[abp]-[A-Za-z0-9-]{20,}|sk-[A-Za-z0-9]{20,})", 0, 1),
    Rule("address", r"[a-z]{3,12}://[^\x20\x09-\x0D/:@]{1,64}:([^\x20\x09-\x0D/:@]{1,64})@", 1, 1),
)


def rule_version(rules: tuple[Rule, ...] = RULES + MORE_RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def scan_text(df: DataFrame, text: str, rules: tuple[Rule, ...] = RULES + MORE_RULES) -> DataFrame:
    """Add `findings`: array<struct<start,rank,kind,end>> ordered by start, then rule order."""
    for r in rules:
        df = find_spans(df, text, r.pattern, f"_{r.kind}", r.group)

    def kept(rank: int, r: Rule) -> Column:
        return F.transform(
            F.filter(f"_{r.kind}", lambda s: F.length(s.part) >= r.least),
            lambda s: F.struct(s.start.alias("start"), F.lit(rank).alias("rank"), F.lit(r.kind).alias("kind"), s.end.alias("end")),
        )

    return df.withColumn("findings", F.array_sort(F.concat(*(kept(i, r) for i, r in enumerate(rules))))).drop(*(f"_{r.kind}" for r in rules))


def scan(
    versions: DataFrame,
    path: str,
    text: str = "text",
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES + MORE_RULES,
) -> tuple[DataFrame, DataFrame]:
    """Return (findings by path, new ledger rows).

    versions: one row per path and version; other columns are ignored. ledger: rows (blob, rule_version, findings) of
    earlier scans, or None. Findings: one row (path, blob, findings) for every input row, repeated rows and null paths
    included; a null text counts as empty. New ledger rows: one for each blob that was scanned now, findings or not;
    append them to the ledger.
    """
    version = rule_version(rules)
    held = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("blob", F.sha2(F.col("_text"), 256))
    blobs = held.groupBy("blob").agg(F.first("_text").alias("_text"))
    known = None
    if ledger is not None:
        # Two runs at once, or one that was repeated, may have added a blob twice.
        known = ledger.where(F.col("rule_version") == version).select("blob", "findings").dropDuplicates(["blob"])
        blobs = blobs.join(known.select("blob"), "blob", "left_anti")
    new = materialize(scan_text(blobs, "_text", rules).select("blob", F.lit(version).alias("rule_version"), "findings"), "ledger")
    every = new.select("blob", "findings")
    if known is not None:
        every = every.unionByName(known)
    # Most blobs hold nothing: only those with findings travel to the join.
    every = every.where(F.size("findings") > 0)
    found = held.select("path", "blob").join(every, "blob", "left")
    none = F.array().cast(new.schema["findings"].dataType)
    return found.select("path", "blob", F.coalesce("findings", none).alias("findings")), new


def scan_into(versions: DataFrame, path: str, folder: str, text: str = "text", rules: tuple[Rule, ...] = RULES + MORE_RULES) -> DataFrame:
    """Findings by path, as scan() gives them, against the ledger that is kept as Parquet in `folder` (none at first).

    Only what the ledger lacks is scanned, and is appended to it in one commit: a run that fails before leaves the ledger as it was,
    one that is repeated scans nothing. The findings come from the ledger as it was and from the table of new ones.
    """
    spark = versions.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    held = spark.read.parquet(folder) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None
    found, new = scan(versions, path, text, held, rules)
    new.write.mode("append").parquet(folder)
    return found
