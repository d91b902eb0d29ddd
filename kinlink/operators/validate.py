"""Checks of a result table (source1_entity_id, ids joined by commas) against the required entities.

``python -m kinlink.operators.validate MATCHES ENTITIES [--candidates FILE] [--known FILE ...]`` prints what is
wrong and ends with code 1 if anything is.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLES = 5


def findings(rows: DataFrame, ids: str, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, offender): every distinct offender of each rule.

    ``rows``: source1_entity_id and ``ids``; ``required``, ``known``: entity_id.  Rules: duplicate_row,
    repeated_id, self_match, wrong_prefix, unknown_id (only with ``known``), missing, extra.
    """
    s = F.col("source1_entity_id")
    split = rows.select(s, F.filter(F.split(F.coalesce(F.col(ids), F.lit("")), ","), lambda x: x != "").alias("list"))
    each = split.select(F.explode("list").alias("id")).distinct()
    of = lambda df, rule, c: df.select(F.lit(rule).alias("rule"), F.col(c).alias("offender")).distinct()
    seen = rows.select(s.alias("entity_id")).distinct()
    out = of(rows.groupBy("source1_entity_id").count().filter("count > 1"), "duplicate_row", "source1_entity_id")
    out = out.unionByName(of(split.filter(F.size("list") != F.size(F.array_distinct("list"))), "repeated_id", "source1_entity_id"))
    out = out.unionByName(of(each.filter(F.col("id").startswith("S1-")), "self_match", "id"))
    foreign = each.filter(~F.col("id").startswith("S1-"))
    out = out.unionByName(of(foreign.filter(~F.col("id").rlike("^S[23]-")), "wrong_prefix", "id"))
    if known is not None:
        out = out.unionByName(of(foreign.filter(F.col("id").rlike("^S[23]-")).join(known.select(F.col("entity_id").alias("id")), "id", "left_anti"), "unknown_id", "id"))
    out = out.unionByName(of(required.select("entity_id").join(seen, "entity_id", "left_anti"), "missing", "entity_id"))
    return out.unionByName(of(seen.join(required.select("entity_id"), "entity_id", "left_anti"), "extra", "entity_id"))


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Entities with a matched id that isn't among their candidates (a warning only)."""
    lists = lambda df, c, n: df.select("source1_entity_id", F.split(F.coalesce(F.col(c), F.lit("")), ",").alias(n))
    both = lists(matches, "matched_entity_ids", "m").join(lists(candidates, "candidate_entity_ids", "c"), "source1_entity_id", "left")
    extra = F.filter(F.array_except("m", F.coalesce("c", F.array().cast("array<string>"))), lambda x: x != "")
    return both.filter(F.size(extra) > 0).select("source1_entity_id")


def report(found: DataFrame) -> DataFrame:
    """(rule, total, examples): up to five sorted offenders of each rule, by a grouped limit."""
    from pyspark.sql.window import Window

    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("rule").orderBy("offender")))
    few = ranked.filter(F.col("k") <= EXAMPLES).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("offender")), ", ").alias("examples"))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("total")).join(few, "rule")


def header_problem(spark, path: str, expected: list[str]) -> str | None:
    """What is wrong with the first line of a file: missing, empty, comma_separated, header; else None."""
    try:
        line = spark.read.text(path).limit(1).collect()
    except Exception as e:  # Spark's own error class for a path that isn't there
        if "PATH_NOT_FOUND" in str(e):
            return "missing"
        raise
    if not line:
        return "empty"
    head = line[0][0]
    if "\t" not in head and "," in head:
        return "comma_separated"
    return None if [c.strip().lower() for c in head.split("\t")] == expected else "header"


def rows_without_tab(lines: DataFrame) -> DataFrame:
    """Lines of a text DataFrame (value) that aren't blank and have no tab."""
    return lines.filter((F.trim("value") != "") & (F.instr("value", "\t") == 0))


COLUMNS = {"matched": "matched_entity_ids", "candidates": "candidate_entity_ids"}
WHAT = {
    "missing": "there is no such file",
    "empty": "the file is empty",
    "comma_separated": "the file is separated by commas, not by tabs",
    "header": "the header isn't the expected one",
}


def check(spark: SparkSession, matches: str, entities: str, candidates: str | None = None, known: list[str] | None = None) -> tuple[list[str], list[str]]:
    """(errors, warnings) of the result files; ``entities``, ``known``: tab-separated files with ids in the first column."""
    from kinlink.sources.tables import read_ids, read_tsv

    errors, warnings, tables = [], [], {}
    required = read_ids(spark, entities)
    ids = None
    for k in known or []:
        ids = read_ids(spark, k) if ids is None else ids.unionByName(read_ids(spark, k))
    for kind, path in (("matched", matches), ("candidates", candidates)):
        if path is None:
            continue
        problem = header_problem(spark, path, ["source1_entity_id", COLUMNS[kind]])
        if problem == "missing" and kind == "candidates":
            warnings.append(f"{path}: {WHAT[problem]}; candidates aren't checked")
        elif problem:
            errors.append(f"{path}: {WHAT[problem]}")
        else:
            lines = rows_without_tab(spark.read.text(path)).count()
            if lines:
                errors.append(f"{path}: {lines} rows without a tab")
            tables[kind] = read_tsv(spark, path).toDF("source1_entity_id", COLUMNS[kind])
            for r in report(findings(tables[kind], COLUMNS[kind], required, ids)).orderBy("rule").collect():  # a row a rule
                errors.append(f"{path}: {r['rule']}: {r['total']}, such as {r['examples']}")
    if len(tables) == 2:
        n = outside_candidates(tables["matched"], tables["candidates"]).count()
        if n:
            warnings.append(f"{n} entities have matches that aren't among their candidates")
    return errors, warnings


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Check the files of a linkage result.")
    parser.add_argument("matches")
    parser.add_argument("entities")
    parser.add_argument("--candidates")
    parser.add_argument("--known", nargs="*")
    a = parser.parse_args(arguments)
    try:
        errors, warnings = check(SparkSession.builder.getOrCreate(), a.matches, a.entities, a.candidates, a.known)
    except Exception as e:  # unreadable bytes or folders: an error of the files, not of the program
        errors, warnings = [f"could not read a file: {e}"], []
    for w in warnings:
        print(f"warning: {w}")
    for e in errors:
        print(f"error: {e}")
    print("failed" if errors else "passed")
    return 1 if errors else 0


if __name__ == "__main__":
    sys.exit(main())
