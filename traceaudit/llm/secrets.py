"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the hash of its content. Only pairs
of blob and rule version that the ledger does not hold are scanned; the findings
of a blob are then joined back to all paths that carry it. All of it are
DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.common import stored

LEDGER_SCHEMA = "blob string, rule string, version int, place int, found array<struct<start: int, stop: int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches are findings if capture ``group`` has ``least`` code points.

    ``hint`` is a shorter pattern that every text with a finding matches.
    """

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 0


# The kinds every scan reports, in the order in which they are listed.
BASE_RULES = (
    Rule("assign", 1, r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         r"(?i:passw|secret|token|api_?key)", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
)
# Public formats of further credentials.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"\.eyJ"),
    Rule("url", 2, r"[a-z][a-z0-9+]{1,15}://[^\s/:@]+:[^\s/@]{4,}@[A-Za-z0-9.-]+", r"://[^\s/@]+@"),
)


def _spans(text: Column, rule: Rule) -> Column:
    """Start and end, in code points, of the rule's findings in ``text``.

    The pieces between the matches and the matches themselves alternate, so the
    running sum of their lengths gives the positions.
    """
    pattern = F.lit(rule.pattern)
    lengths = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    held = (F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g))
            if rule.group else matches)
    steps = F.arrays_zip(lengths.alias("gap"), matches.alias("size"), held.alias("held"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, stop: int>>").alias("found"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        stop = begin + F.coalesce(s["size"], F.lit(0))
        found = F.struct(begin.alias("start"), stop.alias("stop"))
        good = s["size"].isNotNull() & (s["held"] >= rule.least)
        return F.struct(stop.alias("at"), F.when(good, F.concat(acc["found"], F.array(found))).otherwise(acc["found"]).alias("found"))

    walked = F.aggregate(steps, start, step)["found"]
    return F.when(text.rlike(rule.hint), walked)


def addressed(versions: DataFrame, content: str = "content") -> DataFrame:
    """Versions with ``blob``, the SHA-256 of the content; null counts as empty."""
    return versions.withColumn("blob", F.sha2(F.coalesce(versions[content], F.lit("")).cast("binary"), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = BASE_RULES + MORE_RULES,
                content: str = "content") -> DataFrame:
    """Ledger entries for the pairs of blob and rule version that ``ledger`` lacks.

    A pair without findings gets an entry with an empty list, so it is not
    scanned again. Each distinct content is scanned once, however many versions
    carry it; which of them is read makes no difference.
    """
    names = [(r.kind, r.version, i) for i, r in enumerate(rules)]
    blobs = addressed(versions, content).select("blob", F.coalesce(F.col(content), F.lit("")).alias("_text"))
    wanted = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(v).alias("version"), F.lit(i).alias("place")) for k, v, i in names])
    if ledger is not None:
        known = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("_known"))  # one element per rule version
        blobs = blobs.join(known, "blob", "left").withColumn("_todo", F.filter(wanted, lambda w: ~F.coalesce(
            F.array_contains(F.col("_known"), F.struct(w["rule"], w["version"])), F.lit(False))))
        blobs = blobs.filter(F.size("_todo") > 0).select("blob", "_text", "_todo")
    else:
        blobs = blobs.withColumn("_todo", wanted)
    once = blobs.groupBy("blob").agg(F.first("_text").alias("_text"), F.first("_todo").alias("_todo"))
    empty = F.array().cast("array<struct<start: int, stop: int>>")
    entries = []
    for i, r in enumerate(rules):
        todo = F.array_contains(F.transform("_todo", lambda t: t["place"]), i)
        entries.append(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.lit(i).alias("place"),
                                F.when(todo, F.coalesce(_spans(F.col("_text"), r), empty)).alias("found")))
    return (once.select("blob", F.explode(F.array(*entries)).alias("e")).select("blob", "e.*")
            .filter(F.col("found").isNotNull()))


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule], content: str = "content") -> DataFrame:
    """Every version with ``found``: all spans of its blob by start, then by the order of ``rules``.

    ``ledger`` should be a stored table: a blob that a third of the paths carry is
    then split by the adaptive skew join.
    """
    current = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    kinds = {r.kind: i for i, r in enumerate(rules)}
    place = F.element_at(F.create_map(*[F.lit(x) for k, i in kinds.items() for x in (k, i)]), F.col("rule"))
    hits = ledger.filter((F.size("found") > 0) & F.array_contains(current, F.struct("rule", "version")))
    per_blob = stored(hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(F.transform(
        "found", lambda s: F.struct(s["start"].alias("start"), place.alias("place"), s["stop"].alias("stop"), F.col("rule").alias("kind")))))).alias("found")))
    return addressed(versions, content).drop(content).join(per_blob, "blob", "left")


def joined_spans(found: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of the spans, joined by commas; only of the given kinds if there are any."""
    kept = F.filter(found, lambda s: s["kind"].isin(list(kinds))) if kinds else found
    return F.coalesce(F.array_join(F.transform(kept, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","), F.lit(""))


def secret_report(docs: DataFrame, ledger: DataFrame | None = None,
                  rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Secrets of each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob.

    ``docs`` has doc_id and text. One row per row of ``docs``; null texts are
    empty, null and repeated ids are kept as they are, other columns are not
    looked at. A text without findings has zeros and empty strings. The bounded
    list of a blob's findings is the only thing that is gathered.
    """
    versions = docs.select("doc_id", F.col("text").alias("content"))
    fresh = stored(scan_unseen(versions, ledger, rules))
    if ledger is not None:
        fresh = ledger.unionByName(fresh)
    out = findings_by_path(versions, fresh, rules)
    base = [r.kind for r in BASE_RULES]
    count = lambda k: F.coalesce(F.size(F.filter("found", lambda s: s["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    out = out.withColumn("found", F.coalesce("found", F.array().cast(
        "array<struct<start: int, place: int, stop: int, kind: string>>")))
    return out.select("doc_id", *[count(k) for k in base],
                      F.sha2(joined_spans(F.col("found"), base).cast("binary"), 256).alias("base_sha256"),
                      joined_spans(F.col("found")).alias("spans"), "blob")
