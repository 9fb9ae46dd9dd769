"""Integrity checks; each gives (code, severity, subject) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.functions import text as T
from sparkwell.operators import rules as R
from sparkwell.operators.cuts import cut
from sparkwell.operators.similarity import suggest


def faults(rows: DataFrame, subject: Column, code: str, severity: str = "error") -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"))


def unique(rows: DataFrame, keys: list[str], code: str) -> DataFrame:
    """Values of keys that stand in more than one row."""
    return faults(rows.groupBy(*keys).count().where("count > 1"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), code)


def references(rows: DataFrame, subject: str, column: str, targets: DataFrame, key: str, code: str) -> DataFrame:
    """Rows whose non-null reference is no key of targets; see reference_faults for suggestions and wrong kinds."""
    return faults(rows.where(F.col(column).isNotNull()).join(targets.select(F.col(key).alias(column)), column, "left_anti"), F.col(subject), code)


def reference_faults(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(subject, ref, code, suggestion) of rows(subject, ref, kind) whose ref is no key of targets(key, kind) of their kind.

    One that is a key of another kind is a REFERENCE_TYPE_MISMATCH; one that is none is a REFERENCE_NOT_FOUND, with the
    nearest key of the wanted kind if it is near enough. A null reference is none.
    """
    want = rows.where("ref IS NOT NULL").select("subject", F.col("ref").cast("string").alias("ref"), "kind")
    have = targets.select(F.col("key").cast("string").alias("ref"), F.col("kind").alias("of")).distinct()
    lost = want.join(have.withColumnRenamed("of", "kind"), ["ref", "kind"], "left_anti")
    other = have.select("ref").distinct().withColumn("other", F.lit(True))
    told = lost.join(other, "ref", "left").withColumn("code", F.when(F.col("other"), "REFERENCE_TYPE_MISMATCH").otherwise("REFERENCE_NOT_FOUND")).drop("other")
    out = told.where("code <> 'REFERENCE_NOT_FOUND'").withColumn("suggestion", F.lit(None).cast("string"))
    for kind in sorted(r[0] for r in told.select("kind").distinct().collect()):  # kinds of entities: a handful
        keys = have.where(F.col("of") == kind).select(F.col("ref").alias("key"))
        out = out.unionByName(suggest(told.where((F.col("kind") == kind) & (F.col("code") == "REFERENCE_NOT_FOUND")), "ref", keys).drop("distance"))
    return out.select("subject", "ref", "code", "suggestion")


def window_order(rows: DataFrame, subject: str, start: str, end: str) -> DataFrame:
    """Rows whose window ends before it begins."""
    return faults(rows.where(F.col(end) < F.col(start)), F.col(subject), "INVALID_EFFECTIVE_WINDOW")


def allowed(rows: DataFrame, subject: str, column: str, values: list[str], code: str) -> DataFrame:
    return faults(rows.where(F.col(column).isNull() | ~F.col(column).isin(*values)), F.col(subject), code)


def group_kinds(members: DataFrame, groups: DataFrame) -> DataFrame:
    """members(member, grp, kind) whose kind is not that of their group (grp, group_kind)."""
    return faults(members.join(groups, "grp").where("kind <> group_kind"), F.col("member"), "SELECTION_GROUP_TYPE_MISMATCH")


def lifecycle_dependencies(edges: DataFrame, status: DataFrame) -> DataFrame:
    """Published sources of edges(source, target) whose target is not published; status(node, status), an absent status is not."""
    a = status.select(F.col("node").alias("source"), F.col("status").alias("s"))
    b = status.select(F.col("node").alias("target"), F.col("status").alias("t"))
    bad = edges.join(a, "source").join(b, "target", "left").where("s = 'published' AND (t IS NULL OR t <> 'published')")
    return faults(bad, F.concat_ws("->", F.col("source").cast("string"), F.col("target").cast("string")), "INVALID_LIFECYCLE_DEPENDENCY")


def name_collisions(names: DataFrame) -> DataFrame:
    """Names of names(concept_id, name) that several concepts share."""
    return faults(names.groupBy("name").agg(F.countDistinct("concept_id").alias("n")).where("n > 1"), F.col("name"), "CONCEPT_NAME_COLLISION", "warning")


def rule_paths(nodes: DataFrame) -> DataFrame:
    """nodes plus path: from the root down, the kind of each group and the place of the child in it, as in /allOf/0/anyOf/2."""
    place = F.row_number().over(Window.partitionBy("rule_id", "parent_id").orderBy("node_id")) - 1
    placed = cut(nodes.withColumn("place", place))
    level = placed.where("parent_id IS NULL").select("rule_id", "node_id", "kind", F.lit("").alias("path"))
    paths = level.select("rule_id", "node_id", "path")
    while not level.isEmpty():
        up = level.select("rule_id", F.col("node_id").alias("parent_id"), F.concat_ws("/", "path", "kind").alias("above"))
        below = placed.join(up, ["rule_id", "parent_id"]).select("rule_id", "node_id", "kind", F.concat_ws("/", "above", F.col("place").cast("string")).alias("path"))
        level = cut(below)
        paths = paths.unionByName(level.select("rule_id", "node_id", "path"))
    return placed.drop("place").join(paths, ["rule_id", "node_id"], "left")


def rule_faults(nodes: DataFrame, dimensions: DataFrame, values: DataFrame | None = None, authorization: DataFrame | None = None) -> DataFrame:
    """(code, severity, subject, reason): what is wrong in rules before any context is seen; subject is the rule, "#" and the path.

    nodes and dimensions as in operators.rules (dimensions may have a category), values(dim_key, value) are registered,
    authorization(rule_id) names the rules that grant access. Null operands are a missing value, a list is one that is
    there. Groups must have children; a leaf's dimension must be known, or nothing else is said of it; its operator must
    be allowed (presence always is), fit the cardinality and an ordered type; a presence operator has no operand, any
    other one has one: two in order for between, one at least for lists, one else, each of the dimension's type, and
    registered for an enum. In an authorization a dimension that is skipped when missing is unsafe, and one that
    describes or ranks is suspicious. Each fault is a row, so a leaf may have several.
    """
    at = rule_paths(nodes)
    children = nodes.where("parent_id IS NOT NULL").select("rule_id", F.col("parent_id").alias("node_id")).distinct().withColumn("full", F.lit(True))
    group = at.where("kind <> 'leaf'").join(children, ["rule_id", "node_id"], "left")
    kinds = F.when(~F.col("kind").isin(*R.KINDS), "UNKNOWN_KIND").when(F.col("full").isNull(), "EMPTY_GROUP")
    empty = group.select("rule_id", "path", F.lit("INVALID_EXPRESSION").alias("code"), F.lit("error").alias("severity"), kinds.alias("reason")).where("reason IS NOT NULL")

    if "category" not in dimensions.columns:
        dimensions = dimensions.withColumn("category", F.lit(None).cast("string"))
    leaves = at.where("kind = 'leaf'").join(dimensions.select("dim_key", "value_type", "cardinality", "missing", "allowed", "category"), "dim_key", "left")
    guard = authorization.select("rule_id").distinct().withColumn("guards", F.lit(True)) if authorization is not None else None
    leaves = leaves.withColumn("guards", F.lit(False)) if guard is None else leaves.join(guard, "rule_id", "left")
    op, ops, n = F.col("op"), F.col("operands"), F.size("operands")
    presence, lists, given = op.isin(*R.PRESENCE), op.isin("in", "not_in", "includes_any", "includes_all"), ops.isNotNull()
    number, lo, hi = F.col("value_type") == "number", F.get("operands", F.lit(0)), F.get("operands", F.lit(1))
    backwards = F.when(number, lo.try_cast("double") > hi.try_cast("double")).otherwise(lo > hi)

    def fault(condition: Column, code: str, reason: str, severity: str = "error") -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(reason).alias("reason")))

    known = [
        fault(~presence & ~F.array_contains("allowed", op), "INVALID_OPERATOR_FOR_DIMENSION", "NOT_ALLOWED"),
        fault((F.col("cardinality") == "multi") & op.isin(*R.SINGLE), "INVALID_OPERATOR_FOR_DIMENSION", "NEEDS_SINGLE"),
        fault((F.col("cardinality") == "single") & op.isin(*R.MULTI), "INVALID_OPERATOR_FOR_DIMENSION", "NEEDS_MULTI"),
        fault(op.isin(*R.ORDERED) & ~F.col("value_type").isin("number", "date"), "INVALID_OPERATOR_FOR_DIMENSION", "NEEDS_ORDER"),
        fault(presence & given, "INVALID_EXPRESSION", "VALUE_FORBIDDEN"),
        fault(~presence & ~given, "INVALID_EXPRESSION", "VALUE_MISSING"),
        fault(given & F.when(op == "between", n != 2).when(lists, n == 0).when(presence, False).otherwise(n != 1), "INVALID_EXPRESSION", "WRONG_SHAPE"),
        fault((op == "between") & (n == 2) & backwards, "INVALID_EXPRESSION", "REVERSED_BOUNDS"),
        fault(F.col("guards") & (F.col("missing") == "ignore"), "UNSAFE_AUTHORIZATION_MISSING_BEHAVIOR", "SKIPPED_WHEN_MISSING"),
        fault(F.col("guards") & F.col("category").isin("descriptive", "ranking"), "SUSPICIOUS_DIMENSION_CATEGORY_USAGE", "CATEGORY", "warning"),
    ]
    unknown = fault(F.lit(True), "UNKNOWN_DIMENSION", "UNKNOWN_DIMENSION")
    found = F.when(F.col("value_type").isNull(), F.array(unknown)).otherwise(F.array_compact(F.array(*known)))
    whole = leaves.select("rule_id", "path", F.explode(found).alias("x")).select("rule_id", "path", "x.*")

    each = leaves.where("value_type IS NOT NULL").select("rule_id", "path", "dim_key", "value_type", F.posexplode("operands").alias("i", "value"))
    registered = (values.select("dim_key", "value").distinct() if values is not None else each.select("dim_key", "value").distinct()).withColumn("registered", F.lit(True))
    each = each.join(registered, ["dim_key", "value"], "left")
    kind, value = F.col("value_type"), F.col("value")
    wrong = F.when(kind == "number", value.try_cast("double").isNull()).when(kind == "boolean", ~value.isin("true", "false")).when(kind == "date", ~T.valid_date(value)).otherwise(value.isNull() & (kind == "string"))
    code = F.when((kind == "enum") & F.col("registered").isNull(), "DIMENSION_VALUE_NOT_FOUND").when(F.coalesce(wrong, F.lit(True)), "INVALID_FIELD_TYPE")
    typed = each.select("rule_id", F.concat_ws("/", "path", F.lit("value"), F.col("i").cast("string")).alias("path"), code.alias("code"), F.lit("error").alias("severity"), F.lit("WRONG_VALUE").alias("reason")).where("code IS NOT NULL")
    every = empty.unionByName(whole).unionByName(typed)
    return every.select("code", "severity", F.concat_ws("#", "rule_id", "path").alias("subject"), "reason")


def summary(found: DataFrame, strict: bool = False) -> DataFrame:
    """(severity, n); strict counts warnings as errors."""
    severity = F.lit("error") if strict else F.col("severity")
    return found.groupBy(severity.alias("severity")).agg(F.count("*").alias("n"))
