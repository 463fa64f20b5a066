"""Path-pattern rules whose targets name what the source's pattern captured, and rules on imports that lead nowhere."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cuts import cut_table
from .joins import spread
from .policy import _few, fingerprint, selects

#: Most groups that a target may name, $1 to $9.
GROUPS = 9


def escaped(text: Column) -> Column:
    """text as a pattern for itself."""
    return F.regexp_replace(text, "([^A-Za-z0-9])", r"\\$1")


def instantiated(template: Column, captures: Column) -> Column:
    """template with $1 to $9 replaced by captures, an array, as literal text; what is inserted is not read again. Null stays null."""
    parts = F.split(template, "(?=[$][1-9])")
    part = lambda x: F.when(x.rlike("^[$][1-9]"), F.concat(escaped(F.element_at(captures, F.substring(x, 2, 1).cast("int"))), F.substring(x, 3, 1 << 20))).otherwise(x)
    return F.array_join(F.transform(parts, part), "")


def fixed_folder(pattern: Column) -> Column:
    """The folders, with their last slash, that every path a pattern fits begins with; empty if it is not bound to the beginning, or offers choices."""
    literal = F.regexp_extract(pattern, r"^\^([A-Za-z0-9_/ -]*)", 1)
    # What is repeated or optional is no fixed text; a folder before it is.
    return F.when(F.contains(pattern, F.lit("|")), "").otherwise(F.regexp_extract(literal, "^(.*/)", 1))


def check_rules(rules: DataFrame) -> None:
    """Refuse patterns that are none, and targets that name more groups than their source has. Rules are written by people and few."""
    for r in rules.select("rule", "from_path", "to_path", "to_not").toLocalIterator():
        groups = re.compile(r["from_path"]).groups
        for target in (r["to_path"], r["to_not"]):
            named = [int(k) for k in re.findall(r"[$]([1-9])", target or "")]
            if max(named, default=0) > groups:
                raise ValueError(f"{r['rule']}: ${max(named)} names no group of its source")
            re.compile(re.sub(r"[$][1-9]", "", target or ""))


def template_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(fingerprint, rule, severity, from_path, to_path, kind) of edges(from_path, to_path, kind) that a forbidding rule fits.

    rules(rule, from_path, from_not, to_path, to_not, kinds, severity): patterns, null ones hold for from_not and to_not nothing, for to_path
    everything; to_path and to_not may name from_path's groups as $1 to $9. An optional group that is absent is empty. Each different source path
    meets only the rules whose fixed folders it lies in, by equality of the folder, and is matched once; patterns are then made of its captures.
    """
    check_rules(rules)
    r = _few(rules.withColumn("folder", fixed_folder(F.col("from_path"))).withColumnsRenamed({"from_path": "pattern", "from_not": "not_pattern"}))
    e = cut_table(edges.select("from_path", "to_path", "kind").where("from_path is not null and to_path is not null").distinct())
    segments = F.split("from_path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(segments, 1, k), "/"), F.lit("/"))))
    near = e.select("from_path").distinct().select("from_path", F.explode(F.array_distinct(folders)).alias("folder")).join(r, "folder")
    fits = F.rlike(F.col("from_path"), F.col("pattern")) & ~F.coalesce(F.rlike(F.col("from_path"), F.col("not_pattern")), F.lit(False))
    # Empty groups at the end, so that each number names one.
    whole = "concat('(?:', pattern, ')" + "()" * GROUPS + "')"
    captures = F.array(*[F.expr(f"regexp_extract(from_path, {whole}, {k})") for k in range(1, GROUPS + 1)])
    sources = near.where(fits).withColumn("captures", captures)
    sources = cut_table(sources.select("from_path", "rule", "severity", "kinds", instantiated(F.col("to_path"), F.col("captures")).alias("want"), instantiated(F.col("to_not"), F.col("captures")).alias("spare")))
    hit = spread(e, sources, "from_path").where(selects(F.col("kinds"), F.col("kind")))
    to = F.col("to_path")
    hit = hit.where(F.coalesce(F.rlike(to, F.col("want")), F.lit(True)) & ~F.coalesce(F.rlike(to, F.col("spare")), F.lit(False)))
    return hit.select(fingerprint("rule", "from_path", "to_path", "kind").alias("fingerprint"), "rule", "severity", "from_path", "to_path", "kind")


def unresolved_violations(imports: DataFrame, assigned: DataFrame, rules: DataFrame) -> DataFrame:
    """(fingerprint, rule, severity, path, target) of imports(path, target) that resolve to nothing, in a component that a forbid rule of kind unresolved has as a source.

    assigned(path, component), rules as for direct violations; an import that stands several times in a file is one violation.
    """
    r = _few(rules.where("action = 'forbid'").where(F.array_contains("kinds", "unresolved")).select("rule", "severity", F.explode("sources").alias("component")).distinct())
    owner = assigned.select("path", "component").where("component is not null").distinct()
    hit = spread(cut_table(imports.select("path", "target").distinct()), owner, "path").join(r, "component")
    return hit.select(fingerprint("rule", "path", "target").alias("fingerprint"), "rule", "severity", "path", "target").distinct()
