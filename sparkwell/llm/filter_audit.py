"""How filters interact: for every order of them, what each step removes, from counts in a tensor with one axis a filter."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.llm.stash import free

#: Along an axis: documents that pass its filter, fail it, or all.
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def contract(tensor: np.ndarray, chosen: list[list[tuple[int, int]]]) -> np.ndarray:
    """For every choice of one selection an axis, the sum of what it selects; tensor is (weights, 2, ..., 2), the result (weights, choices)."""
    axes = tensor.ndim - 1
    args: list = [tensor, [0, *range(1, axes + 1)]]
    for a in range(axes):
        args += [np.array([c[a] for c in chosen], np.int64), [axes + 1, a + 1]]
    return np.einsum(*args, [0, axes + 1], optimize="greedy")


def audit_part(tensor: np.ndarray) -> list[dict]:
    """One row for each order and step. tensor[0] counts documents by which filters they fail, further ones those that are missed when lost."""
    k = tensor.ndim - 1
    orders = list(permutations(range(k)))
    steps = [(o, i) for o in orders for i in range(k)]

    def choose(rule) -> np.ndarray:
        return contract(tensor, [[rule(a, o[:i], o[i]) for a in range(k)] for o, i in steps])

    kept = choose(lambda a, before, here: PASS if a in before or a == here else ALL)
    removed = choose(lambda a, before, here: PASS if a in before else FAIL if a == here else ALL)
    failing = choose(lambda a, before, here: FAIL if a == here else ALL)
    only = choose(lambda a, before, here: FAIL if a == here else PASS)
    own = np.zeros(k, np.int64)
    np.add.at(own, [o[i] for o, i in steps], removed[0])
    return [
        {"order": o, "step": i + 1, "kept": int(kept[0, x]), "removed": int(removed[0, x]), "redundant": int(failing[0, x] - removed[0, x]), "unique_fails": int(only[0, x]), "lost": removed[1:, x].tolist(), "shapley": int(own[o[i]])}
        for x, (o, i) in enumerate(steps)
    ]


def first_of_equal(rows: DataFrame, same: Column, id_col: str, keys: list[str]) -> DataFrame:
    """rows counted by keys: (keys, later, n), later telling rows whose `same` a row of a smaller id has, too.

    Equal rows are counted together before each shuffle, so that no group of copies meets in one task: by all of keys
    and id, then without id, and only the few lines of one `same` that are left look at each other's least id. A null id
    is no smaller than any and has no smaller one; rows with the same id as the least are none of them later.
    """
    s, i, n, low, at_low, no_id, least, off = free(rows, "same", "id", "n", "low", "at_low", "no_id", "least", "later_n")
    by = [F.col(f"`{c}`") for c in keys]
    each = rows.groupBy(*by, same.alias(s), F.col(f"`{id_col}`").alias(i)).agg(F.count("*").alias(n))
    some = each.groupBy(*by, s).agg(F.sum(n).alias(n), F.min(i).alias(low), F.min_by(n, i).alias(at_low), F.sum(F.when(F.col(i).isNull(), F.col(n)).otherwise(0)).alias(no_id))
    both = some.withColumn(least, F.min(low).over(Window.partitionBy(s)))
    first = F.when(F.col(low) == F.col(least), F.col(at_low)).otherwise(0) + F.col(no_id)
    counted = both.withColumn(off, F.col(n) - first)
    parts = counted.groupBy(*by).agg(F.sum(off).alias("late"), F.sum(n).alias("every"))
    pair = F.explode(F.array(F.struct(F.lit(False).alias("later"), (F.col("every") - F.col("late")).alias("n")), F.struct(F.lit(True).alias("later"), F.col("late").alias("n"))))
    return parts.select(*by, pair.alias("x")).select(*by, "x.later", "x.n")


def audit(counts: DataFrame, part: str, fails: list[str], weights: list[str], letters: str, order_name: str = "filter_order") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, one column a further weight, shapley) for all orders.

    counts: rows of (part, one boolean for each filter, weights), the first weight counting documents; equal ones are
    summed, so at most 2 to the power of the filters stand for a part, whatever its documents. further weights are
    columns named by what they count; each gives how much of it a step loses. A null boolean passes.
    """
    total = counts.groupBy(F.col(part).alias("part"), *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in fails]).agg(*[F.sum(w).cast("long").alias(w) for w in weights])
    lost = weights[1:]
    schema = f"part string, {order_name} string, step int, kept long, removed long, redundant long, unique_fails long, " + "".join(f"{w} long, " for w in lost) + "shapley long"

    def one_part(t: pa.Table) -> pa.Table:
        tensor = np.zeros((len(weights), *[2] * len(fails)), np.int64)
        at = tuple(t[f].to_numpy().astype(np.int64) for f in fails)
        for i, w in enumerate(weights):
            np.add.at(tensor[i], at, t[w].to_numpy())
        rows = audit_part(tensor)
        out = {"part": [t["part"][0].as_py()] * len(rows), order_name: ["".join(letters[a] for a in r["order"]) for r in rows]}
        out |= {c: [r[c] for r in rows] for c in ("step", "kept", "removed", "redundant", "unique_fails")}
        out |= {w: [r["lost"][i] for r in rows] for i, w in enumerate(lost)} | {"shapley": [r["shapley"] for r in rows]}
        return pa.table({c: pa.array(v, pa.string() if c in ("part", order_name) else pa.int32() if c == "step" else pa.int64()) for c, v in out.items()})

    return total.groupBy("part").applyInArrow(one_part, schema)


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that a text alone decides, as failure conditions: short, repetitive, shouting, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n, "C": 100 * capitals > 3 * F.length(text), "D": F.rlike(text, F.lit("[#$%&*|]"))}


def audit_documents(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", part: str = "lang") -> DataFrame:
    """The audit of five filters (text_failures, and E: a smaller id has the same text) by part, with good and toxic documents lost.

    A null text is empty, a null part the empty string. Texts are read whole and compared by their sha256. An id that
    has several labels is good or toxic if any says so; rows that repeat an id count each and are no copies of each
    other; a row without an id is no copy and has none. An empty table gives an empty result. Other columns of docs are
    not read, so their names cannot clash.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    marks = text_failures(F.col("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("same"), *[F.coalesce(c, F.lit(False)).alias(k) for k, c in marks.items()])
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max((F.col("quality") == 1)), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(known, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    counted = first_of_equal(rows, F.col("same"), "id", ["part", *marks, "good", "toxic"]).withColumnRenamed("later", "E")
    counted = counted.withColumns({"good_lost": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic_lost": F.when(F.col("toxic"), F.col("n")).otherwise(0)})
    return audit(counted, "part", [*marks, "E"], ["n", "good_lost", "toxic_lost"], "ABCDE")
