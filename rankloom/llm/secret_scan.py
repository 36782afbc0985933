"""Secret scans through an incremental ledger of blobs.

The ledger is a Parquet table in a shared folder: a blob (the SHA-256 of a text), the versions of the rules that it has
been scanned with, and what they found. A call addresses every version of every file by its content, works out which
pairs of blob and rule version no earlier call has scanned, scans one text of each such blob with the rules it lacks,
appends the findings and joins them back to all paths and versions that hold the blob. A rule whose pattern, group or
length changes has another version, so it alone is scanned again; a blob that comes back under another path costs no scan.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, materialise, scratch, slices, stored_table

FOUND = "array<struct<rule: string, start: long, end: long>>"
LEDGER_SCHEMA = f"blob binary, rules array<string>, findings {FOUND}"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`; those whose group `group` is shorter than `least` are dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    fold: bool = False

    @property
    def version(self) -> str:
        """Names what the rule does: equal versions find equal spans."""
        return hashlib.sha256(repr(("spans in code points", self.pattern, self.least, self.group, self.fold)).encode()).hexdigest()[:32]


#: The base kinds, then two public formats of keys that are secret wherever they stand. Every pattern is
#: linear in the text: what may follow a start can't hold another start of which it must be tried again.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
)


@lru_cache(maxsize=64)
def compiled(rule: Rule) -> re.Pattern:
    """re.ASCII: either case is that of the letters A to Z, not of signs that fold to them."""
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.fold else 0))


def spans(rule: Rule, text: str) -> list[tuple[int, int]]:
    """(start, end) in code points, end exclusive."""
    return [m.span() for m in compiled(rule).finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_batch(rules: tuple[Rule, ...]):
    by_version = {r.version: r for r in rules}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for part in slices(batch):
            for text, lacking in zip(part.column("text").to_pylist(), part.column("rules").to_pylist()):
                found.append([{"rule": v, "start": a, "end": b} for v in lacking for a, b in spans(by_version[v], text)])
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules"), pa.array(found, kind)], ["blob", "rules", "findings"])

    return run


def read_ledger(spark: SparkSession, path: str | None, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, rules, findings: one row for each blob that was scanned with any of these rules, and nothing of others.

    Calls that ran at one time may have stored a pair twice, with equal findings; reading folds them.
    """
    ours = F.array(*[F.lit(r.version) for r in rules])
    rows = stored_table(spark, path, LEDGER_SCHEMA).select("blob", F.array_intersect("rules", ours).alias("rules"), F.filter("findings", lambda x: F.array_contains(ours, x["rule"])).alias("findings"))
    fold = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return rows.where(F.size("rules") > 0).groupBy("blob").agg(fold("rules"), fold("findings"))


def unseen(keys: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, mark, rules: for each blob that lacks rules, those rules, and the mark of one of the rows that hold it."""
    ours = F.array(*[F.lit(r.version) for r in rules])
    lacking = F.when(F.col("known").isNull(), ours).otherwise(F.array_except(ours, F.col("known")))
    blobs = keys.groupBy("blob").agg(F.min("mark").alias("mark")).join(ledger.select("blob", F.col("rules").alias("known")), "blob", "left")
    return blobs.select("blob", "mark", lacking.alias("rules")).where(F.size("rules") > 0)


def scan(versions: DataFrame, at: list[str], ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The columns `at` (which name a path and its version), blob and findings, for every row of `versions`.

    findings: the spans of all rules in the row's text, as (kind, start, end) in code points, by start and then by the order
    of the rules. A null text is scanned as the empty one; rows that are repeated, or share an id, a null id or a text, each
    get their row, and their text is scanned once; an empty table gives an empty result; other columns are ignored, and
    columns of `at` may have any name. Without a path the ledger is a new table that goes with the process. Copies of a text
    meet as one row for each task that reads them, and a text is held whole by the task that scans it.
    """
    spark = versions.sparkSession
    path = ledger_path or scratch(spark, "secret-ledger", keep=False)
    version = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(at)])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = versions.select(version.alias("version"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"), F.xxhash64(version).alias("mark"))
    keys = rows.select("version", "blob", "mark")
    wanted = materialise(unseen(keys, read_ledger(spark, path, rules), rules), "unseen-blobs")
    # Rows that are repeated fold into one before they move; then each wanted blob finds its one row.
    texts = rows.groupBy("blob", "mark").agg(F.first("text").alias("text")).join(wanted, ["blob", "mark"])
    in_arrow(texts.select("blob", "text", "rules"), scan_batch(rules), LEDGER_SCHEMA).write.mode("append").parquet(path)
    found = read_ledger(spark, path, rules).select("blob", in_order(F.col("findings"), rules).alias("findings"))
    return keys.join(found, "blob").select(*[F.col(f"version.c{k}").alias(c) for k, c in enumerate(at)], "blob", "findings")


def in_order(findings: Column, rules: tuple[Rule, ...]) -> Column:
    """Findings by kind instead of version, sorted by start, then by the order of the rules."""
    place = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.version), F.lit(k))])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    ordered = F.array_sort(F.transform(findings, lambda x: F.struct(x["start"].alias("start"), place[x["rule"]].alias("rule"), x["end"].alias("end"))))
    return F.transform(ordered, lambda x: F.struct(F.get(kinds, x["rule"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def listed(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
