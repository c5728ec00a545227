"""Rule-driven prompt rewriting and the check that a rewrite removed something."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceaudit.functions.text import let, lines_of, literal_pattern, type_slug
from traceaudit.functions.jsontext import stripped
from traceaudit.operators.lookup import lookup_join

# The rewriting operations a rule can name.
OPS = ("weaken", "remove_exact", "remove_line", "remove_lines", "remove_paragraph", "remove_block")

# Letters that match another letter when case is ignored although lower-casing tells them apart.
ODD_CASE = r"[\x{130}\x{131}\x{17F}\x{1C5}\x{1C8}\x{1CB}\x{1F2}\x{345}\x{370}-\x{3FF}\x{1C80}-\x{1C88}\x{1E9B}\x{1E9E}\x{1F80}-\x{1FFF}\x{2126}\x{212A}\x{212B}]"

RULE_SCHEMA = T.StructType([
    T.StructField("violation_id", T.StringType()),
    T.StructField("target_agent", T.StringType()),
    T.StructField("violation_category", T.StringType()),
    T.StructField("violation_name", T.StringType()),
    T.StructField("hard_soft", T.StringType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("op", T.StringType()),
    T.StructField("anchor", T.StringType()),
    T.StructField("replacement", T.StringType()),
    T.StructField("end_anchor", T.StringType()),
    T.StructField("note", T.StringType()),
])


def precheck_diff(pairs: DataFrame, original: str = "original_system_prompt",
                  modified: str = "modified_system_prompt", samples: int = 10) -> DataFrame:
    """Did the modified prompt lose a line of the original?

    ``PASS`` rows carry the number of distinct lines lost and gained and up to
    ``samples`` of each in sorted order; ``REJECT`` rows carry the reason.
    """
    before, after = F.array_distinct(lines_of(F.col(original))), F.array_distinct(lines_of(F.col(modified)))
    marked = (pairs.withColumn("__gone", F.array_except(before, after))
                   .withColumn("__new", F.array_except(after, before)))
    same = F.col(original).eqNullSafe(F.col(modified))
    ok = ~same & (F.size("__gone") > 0)
    return marked.select(
        *[c for c in pairs.columns if c not in (original, modified)],
        F.when(ok, "PASS").otherwise("REJECT").alias("status"),
        F.when(~ok, "injection_failed_no_diff").alias("reason"),
        F.when(same, "identical").when(~ok, "nothing_removed").alias("details"),
        F.when(ok, F.size("__gone").cast("bigint")).alias("lines_removed"),
        F.when(ok, F.size("__new").cast("bigint")).alias("lines_added"),
        F.when(ok, F.slice(F.array_sort("__gone"), 1, samples)).alias("removed_sample"),
        F.when(ok, F.slice(F.array_sort("__new"), 1, samples)).alias("added_sample"),
    )


def _without(items: Column, spot: Column) -> Column:
    """Items except the one at the 1-based position."""
    return F.concat(F.slice(items, 1, F.greatest(spot - 1, F.lit(0))), F.slice(items, spot + 1, F.size(items)))


def _holds(anchor: Column):
    """Test for a text that holds ``anchor`` in any case.

    Lower-casing both sides decides all texts but those with letters whose case
    partner is not their lower-case form; these use a regular expression.
    """
    def test(x: Column) -> Column:
        return F.when(F.regexp_like(F.concat(x, anchor), F.lit(ODD_CASE)), F.regexp_like(x, literal_pattern(anchor))
                      ).otherwise(F.contains(F.lower(x), F.lower(anchor)))
    return test


def _drop_first(items: Column, anchor: Column, glue: str) -> Column:
    """Struct (text, removed): items joined again without the first that holds the anchor."""
    def drop(parts: Column) -> Column:
        place = F.array_position(F.transform(parts, _holds(anchor)), True).cast("int")
        return let(place, lambda spot: F.struct(
            F.array_join(F.when(spot > 0, _without(parts, spot)).otherwise(parts), glue).alias("text"),
            F.when(spot > 0, stripped(F.get(parts, spot - 1))).alias("removed")))
    return let(items, drop)


def _drop_all(items: Column, anchors: Column, glue: str) -> Column:
    """Struct (text, removed): items joined again without those that hold any of the anchors."""
    def drop(parts: Column) -> Column:
        marked = F.transform(parts, lambda x: F.struct(x.alias("x"), F.exists(anchors, lambda a: _holds(a)(x)).alias("hit")))
        return let(marked, lambda m: let(F.filter(m, lambda p: p["hit"]), lambda gone: F.struct(
            F.array_join(F.transform(F.filter(m, lambda p: ~p["hit"]), lambda p: p["x"]), glue).alias("text"),
            F.when(F.size(gone) > 0, F.array_join(F.transform(gone, lambda p: stripped(p["x"])), "\n")).alias("removed"))))
    return let(items, drop)


def _apply(text: Column, rule: Column) -> Column:
    """Struct (text, removed) after one rule; ``removed`` is null when the rule found nothing."""
    nothing = F.lit(None).cast("string")

    def made(new: Column, removed: Column) -> Column:
        return F.struct(new.alias("text"), removed.alias("removed"))

    anchor, op = rule["anchor"], rule["op"]
    loose = literal_pattern(anchor)
    at = F.instr(text, anchor)

    head = F.substr(text, F.lit(1), at - 1)
    tail = F.substr(text, at + F.length(anchor))
    weaken = made(F.when(at > 0, F.concat(head, rule["replacement"], tail)).otherwise(text),
                  F.when(at > 0, anchor))
    remove_exact = made(F.when(at > 0, stripped(F.concat(head, tail))).otherwise(text), F.when(at > 0, anchor))
    lines, blocks = F.split(text, "\n", -1), F.split(text, r"(?U)\n\s*\n", -1)
    remove_line = _drop_first(lines, anchor, "\n")
    remove_lines = _drop_all(lines, F.split(anchor, "\\|\\|", -1), "\n")
    remove_paragraph = _drop_first(blocks, anchor, "\n\n")

    start = F.regexp_instr(text, loose)
    after = F.substr(text, start + F.length(anchor))
    stop = F.regexp_instr(after, literal_pattern(rule["end_anchor"]))
    rest = F.when(F.coalesce(stop, F.lit(0)) > 0, F.substr(after, stop)).otherwise("")
    cut = F.substr(text, start, F.length(text) - start + 1 - F.length(rest))
    remove_block = made(F.when(start > 0, F.concat(F.substr(text, F.lit(1), start - 1), rest)).otherwise(text),
                        F.when(start > 0, stripped(cut)))
    return (F.when(op == "weaken", weaken).when(op == "remove_exact", remove_exact)
             .when(op == "remove_line", remove_line).when(op == "remove_lines", remove_lines)
             .when(op == "remove_paragraph", remove_paragraph).when(op == "remove_block", remove_block)
             .otherwise(made(text, nothing)))


def rewrite_prompts(prompts: DataFrame, rules: DataFrame, text: str = "system_prompt") -> DataFrame:
    """Apply the rule list of each prompt's (violation_id, target_agent), in ``seq`` order.

    Prompts whose cell has no rules come out unchanged with an ``error``. In a
    ``remove_lines`` rule several anchors are separated by ``||``.
    """
    cells = rules.groupBy("violation_id", "target_agent").agg(
        F.array_sort(F.collect_list(F.struct("seq", "op", "anchor", "replacement", "end_anchor", "note"))).alias("__rules"),
        F.first("violation_category").alias("violation_category"),
        F.first("violation_name").alias("violation_name"), F.first("hard_soft").alias("hard_soft"))
    staged = lookup_join(prompts, cells, ["violation_id", "target_agent"])
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        "__rules", F.struct(F.col(text).alias("text"), empty.alias("removed")),
        lambda acc, rule: let(_apply(acc["text"], rule), lambda step: _merge(acc, step)))
    out = staged.withColumn("__out", folded)
    known = F.col("__rules").isNotNull()
    return out.select(
        *prompts.columns,
        F.when(known, F.col("__out.text")).otherwise(F.col(text)).alias("modified_prompt"),
        F.when(known, F.struct(
            F.col("violation_id").alias("violation"), F.col("violation_category").alias("category"),
            type_slug(F.col("violation_name")).alias("type"), F.col("hard_soft"),
            F.array_join(F.transform("__rules", lambda r: r["note"]), "; ").alias("manipulation"),
            F.filter("__out.removed", lambda r: r != "").alias("removed_items"))).alias("change_info"),
        F.when(~known, F.concat(F.lit("unsupported: "), F.col("violation_id"), F.lit("/"), F.col("target_agent")))
         .alias("error"))


def _merge(acc: Column, step: Column) -> Column:
    removed = F.when(step["removed"].isNull(), acc["removed"]).otherwise(
        F.concat(acc["removed"], F.array(step["removed"])))
    return F.struct(step["text"].alias("text"), removed.alias("removed"))


def check_cells(requested: DataFrame, rules: DataFrame) -> DataFrame:
    """Requested (violation_id, target_agent) cells that have no rules."""
    cells = rules.select("violation_id", "target_agent").distinct()
    return requested.select("violation_id", "target_agent").distinct().join(
        cells, ["violation_id", "target_agent"], "left_anti")


def rules_frame(spark, rows: Sequence[tuple]) -> DataFrame:
    """Rule table from tuples in the order of ``RULE_SCHEMA``."""
    return spark.createDataFrame(list(rows), RULE_SCHEMA)
