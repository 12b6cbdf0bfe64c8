"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text.  The
ledger says which rules, with their versions, each blob has been scanned with
and what they found.  A scan reads one copy of each blob that misses a rule and
applies only the rules it misses; findings are joined back to all paths.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutover.llm.common import with_columns_by_batch

FOUND_DDL = "array<struct<start:long,place:long,kind:string,stop:long,rule:string>>"
LEDGER_DDL = f"blob string, rules array<string>, found {FOUND_DDL}"


@dataclass(frozen=True)
class Rule:
    """A pattern for one kind of secret.

    ``least`` is the length that the group of that number must have; matches
    that fail it are dropped, and are not looked into again.  A text can only
    match if it holds one of ``needs`` in lower case.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


#: Kinds in the order in which spans of one start are listed.
RULES = (
    Rule("assign", 1, r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key-----",)),
)
BASE_KINDS = ("assign", "access", "hex")


def blob_of(text: Column) -> Column:
    """Address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def spans(text: str, rules: tuple[Rule, ...]) -> list[tuple[int, int, str, int]]:
    """(start, place of the rule, kind, end) of each finding, in code points, sorted."""
    small = text.lower()
    out = []
    for place, rule in enumerate(rules):
        if rule.needs and not any(n in small for n in rule.needs):
            continue
        for m in re.finditer(rule.pattern, text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((m.start(), place, rule.kind, m.end()))
    return sorted(out)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger entries for the blobs of ``versions``: (blob, rules, found).

    Only pairs of blob and rule version that the ledger lacks are scanned, and
    a text that occurs in many versions is scanned once.  Append the result to
    the ledger.  An empty table gives no entries; null text is the empty blob.
    """
    wanted = F.array(*(F.lit(r.name) for r in rules))
    # the copies of a text meet where they are read, before anything is shuffled
    blobs = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        blobs = blobs.withColumn("rules", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen").filter(F.size("rules") > 0)

    def rows(texts: list, names: list) -> list[tuple]:
        out = []
        for t, these in zip(texts, names, strict=True):
            # the place of a rule among all rules, not among those that are new
            hit = spans(t, tuple(r if r.name in these else Rule(r.kind, r.version, r"(?!)") for r in rules))
            out.append(([{"start": a, "place": p, "kind": k, "stop": b, "rule": rules[p].name} for a, p, k, b in hit],))
        return out

    return with_columns_by_batch(blobs, f"found {FOUND_DDL}", rows, ("text", "rules"), drop=("text",))


def join_back(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Append ``found`` to every version: what the given rules found in its blob, by start and place.

    A version whose blob has no findings, or isn't in the ledger yet, gets an
    empty list.  Findings carry the rule version that made them; those of
    versions that aren't asked for don't count, whatever else the blob was
    scanned with.  Spans of one start are listed in the order of ``rules``.
    """
    names = F.array(*(F.lit(r.name) for r in rules))
    asked = F.filter(F.flatten(F.collect_list("found")), lambda s: F.array_contains(names, s["rule"]))
    placed = F.transform(asked, lambda s: F.struct(s["start"].alias("start"), (F.array_position(names, s["rule"]) - 1).alias("place"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["rule"].alias("rule")))
    hits = ledger.filter(F.size("found") > 0).groupBy("blob").agg(F.array_sort(F.array_distinct(placed)).alias("found"))
    rest = [c for c in versions.columns if c.lower() not in {"blob", "found"}]
    keyed = versions.select(*rest, blob_of(F.col(text)).alias("blob"))
    # one blob may have very many versions: a large side that is split where it is skewed
    return keyed.join(hits, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(FOUND_DDL)))


def listed(found: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def of_kind(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))
