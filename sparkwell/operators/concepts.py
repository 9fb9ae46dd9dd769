"""Concept resolution for a batch of texts: exact, lexical, similar and semantic matches, the strongest kept per concept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.functions import text as T
from sparkwell.operators.cuts import cut, written
from sparkwell.operators.similarity import few_texts, matches, trigram_join

#: Match classes from strong to weak; fixed names.
CLASSES = ["EXACT_KEY", "EXACT_NAME", "EXACT_ALIAS", "LEXICAL", "TRIGRAM", "SEMANTIC"]
#: Concepts that a task compares with the texts; their files are far smaller than what matches.
SPREAD = 5000


def folded(c: Column) -> Column:
    return T.fold_accents(T.normalize(c))


def substring_join(left: DataFrame, left_id: str, left_text: str, right: DataFrame, right_id: str, right_text: str) -> DataFrame:
    """(left_id, right_id) where the right text holds the left one: they meet by the left text's rarest run of three letters.

    A shorter text meets by itself. Runs that many right texts share, such as "the", so meet only what holds nothing rarer.
    """
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, F.lit(n)))
    a = left.select(F.col(left_text).alias("ta")).where(F.length("ta") > 0).distinct()
    a = a.select("ta", F.explode(F.array_distinct(F.when(F.length("ta") < 3, F.array("ta")).otherwise(runs(F.col("ta"), 3)))).alias("run"))
    b = right.select(F.col(right_text).alias("tb")).where(F.length("tb") > 0).distinct()
    b = cut(b.select("tb", F.explode(F.array_distinct(F.concat(runs(F.col("tb"), 1), runs(F.col("tb"), 2), runs(F.col("tb"), 3)))).alias("run")))
    often = b.groupBy("run").agg(F.count("*").alias("often"))
    rarest = a.join(often, "run", "left").groupBy("ta").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "run")).alias("x")).select("ta", "x.run")
    near = rarest.join(b, "run").where(F.contains("tb", "ta")).select("ta", "tb")
    near = near.join(left.select(F.col(left_id), F.col(left_text).alias("ta")), "ta").select(left_id, "tb")
    return near.join(right.select(F.col(right_id), F.col(right_text).alias("tb")), "tb").select(left_id, right_id)


def _fuzzy(asked: DataFrame, named: DataFrame) -> DataFrame:
    """(request_id, concept_id, matched_text, inside, score) of asked(request_id, q) and named(name_id, concept_id, matched_text, n), by shuffled joins.

    Rows of both sides come from explodes, so Spark takes them for smaller than they are; hints keep them from being broadcast.
    """
    inside = substring_join(asked, "request_id", "q", named, "name_id", "n").withColumn("inside", F.lit(True))
    similar = trigram_join(asked, "request_id", "q", named, "name_id", "n").select("request_id", "name_id").withColumn("similar", F.lit(True))
    both = inside.join(similar.hint("merge"), ["request_id", "name_id"], "full_outer").join(named.hint("merge"), "name_id").join(asked.select("request_id", "q").hint("merge"), "request_id")
    return both.withColumn("score", T.trigram_similarity(T.trigrams(F.col("n")), T.trigrams(F.col("q"))))


def match_hits(requests: DataFrame, concepts: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """(request_id, concept_id, class, matched_text, score) of every match.

    requests(request_id, text), concepts(concept_id, key, name, alias, status; an alias may be null), semantic
    (request_id, concept_id, score). EXACT_KEY compares the text as it is, the others folded ones; only published
    concepts match, and an empty text matches nothing.
    """
    live = concepts.where("status = 'published'").select("concept_id", "key", "name", "alias")
    # written, so that Spark knows the requests for the smaller side of each join
    asked = written(requests.select("request_id", "text", folded(F.col("text")).alias("q")).where("q <> ''"))
    none = F.lit(None).cast("double")
    hits = asked.join(live, F.col("text") == F.col("key")).select("request_id", "concept_id", F.lit("EXACT_KEY").alias("class"), F.col("key").alias("matched_text"), none.alias("score"))
    for what, cls in (("name", "EXACT_NAME"), ("alias", "EXACT_ALIAS")):
        named = live.select("concept_id", F.col(what).alias("matched_text"), folded(F.col(what)).alias("q"))
        hits = hits.unionByName(asked.join(named, "q").select("request_id", "concept_id", F.lit(cls).alias("class"), "matched_text", none.alias("score")))
    # all names in one table, so that they are compared in one pass
    dealt = live.repartition(1 + live.count() // SPREAD, "concept_id")
    named = dealt.select("concept_id", F.posexplode(F.array("key", "name", "alias")).alias("field", "matched_text")).where("matched_text IS NOT NULL")
    few = few_texts(asked, "request_id", "q")
    if few is not None:
        both = matches(few, asked.schema["request_id"], named.select("concept_id", "matched_text", folded(F.col("matched_text")).alias("n")), "n", inside=True).withColumnRenamed("held", "inside")
    else:
        both = _fuzzy(cut(asked), cut(named.select(F.xxhash64("concept_id", "field").alias("name_id"), "concept_id", "matched_text", folded(F.col("matched_text")).alias("n"))))
    hits = hits.unionByName(both.select("request_id", "concept_id", F.when(F.col("inside"), "LEXICAL").otherwise("TRIGRAM").alias("class"), "matched_text", F.round("score", 9).alias("score")))
    if semantic is not None:
        hits = hits.unionByName(written(semantic).join(live, "concept_id").join(asked.select("request_id"), "request_id").select("request_id", "concept_id", F.lit("SEMANTIC").alias("class"), F.col("name").alias("matched_text"), "score"))
    return hits


def strongest(hits: DataFrame) -> DataFrame:
    """One hit per request and concept: class, then higher score, then smaller text."""
    place = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("class")).cast("int")
    best = hits.groupBy("request_id", "concept_id").agg(F.min(F.struct(place.alias("place"), (-F.coalesce("score", F.lit(0.0))).alias("neg"), "matched_text", "class", "score")).alias("h"))
    return best.select("request_id", "concept_id", "h.class", "h.matched_text", "h.score", "h.place")


def resolve_concepts(requests: DataFrame, concepts: DataFrame, semantic: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """(request_id, concept_id, class, matched_text, score, rank): exact classes by key and id, the others by score and id."""
    best = strongest(match_hits(requests, concepts, semantic))
    near = Window.partitionBy("request_id").orderBy("place", -F.coalesce("score", F.lit(0.0)), "concept_id")
    # only exact ones are ordered by key; of the others no more than `limit` can come in
    near = best.where("place > 3").withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= limit).withColumn("key", F.lit(None).cast("string"))
    exact = best.where("place <= 3").join(concepts.select("concept_id", "key").hint("merge"), "concept_id")
    order = Window.partitionBy("request_id").orderBy("place", "key", -F.coalesce("score", F.lit(0.0)), "concept_id")
    both = exact.unionByName(near.select(exact.columns)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return both.select("request_id", "concept_id", "class", "matched_text", "score", "rank")


def ambiguous(hits: DataFrame) -> DataFrame:
    """(request_id, n, concept_ids): requests whose exact name or alias stands for several concepts."""
    exact = strongest(hits).where(F.col("class").isin("EXACT_NAME", "EXACT_ALIAS"))
    return exact.groupBy("request_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("concept_id")).alias("concept_ids")).where("n > 1")
