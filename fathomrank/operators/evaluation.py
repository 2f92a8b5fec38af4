"""Evaluation: nDCG, arms, paired bootstrap, sweeps, tie diagnostics, recall."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomrank.functions.columns import ordered_sum
from fathomrank.operators.fusion import Fuser
from fathomrank.operators.scorers import GraphScorer, Scorer
from fathomrank.operators.search import Streams
from fathomrank.operators.topk import ranking, top_k
from fathomrank.schema import BadQueryId, DuplicateQuery, DuplicateRanked, ForeignDocument, NoIterations, NoQueries, NoScorers, OverfetchRange, UnknownQuery, UnmatchedVectors, Unpaired
from fathomrank.shared import write_table


@dataclass
class Arm:
    name: str
    scorers: tuple[Scorer, ...]
    fuser: Fuser
    overfetch: int = 1


def _gain(grade, rank):
    return F.greatest(F.coalesce(grade, F.lit(0)), F.lit(0)).cast("double") / F.log2(rank.cast("double") + F.lit(1.0))


def ndcg(queries: DataFrame, ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(qid, ndcg) of every query: linear gain; unjudged and negative grades count 0; nothing relevant, 0.

    ``qrels`` is (qid, doc, grade), or (doc, grade) where a document's grade holds for all queries.
    """
    shared = "qid" not in qrels.columns
    on = ["doc"] if shared else ["qid", "doc"]
    cut = ranked.where(F.col("rank") <= k).join(qrels, on, "left")
    dcg = cut.groupBy("qid").agg(ordered_sum(F.col("rank"), _gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    good = qrels.where("grade > 0")
    if shared:
        best = good.orderBy(F.desc("grade"), "doc").limit(k).withColumn("qid", F.lit(""))
    else:
        best = good
    place = Window.partitionBy("qid").orderBy(F.desc("grade"), "doc")
    ideal = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).groupBy("qid").agg(ordered_sum(F.col("rank"), _gain(F.col("grade"), F.col("rank"))).alias("idcg"))
    rows = queries.select("qid").join(dcg, "qid", "left")
    if shared:  # one row for all queries
        rows = rows.withColumn("_one", F.lit("")).join(F.broadcast(ideal.withColumnRenamed("qid", "_one")), "_one", "left")
    else:
        rows = rows.join(ideal, "qid", "left")
    value = F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.when(F.col("idcg") > 0, F.col("idcg"))).otherwise(F.lit(0.0))
    return rows.select("qid", value.alias("ndcg"))


def check(queries: DataFrame, arms: list[Arm], k: int, qrels: DataFrame | None = None, corpus=None) -> None:
    """Refuse what can't be evaluated."""
    if k <= 0:
        raise ValueError("k must be positive")
    if any(a.overfetch < 1 for a in arms):
        raise OverfetchRange("over-fetch below 1")
    if any(not a.scorers for a in arms):
        raise NoScorers("an arm has no scorer")
    n, bad, distinct = queries.agg(F.count("*"), F.count_if(F.col("qid").isNull() | (F.col("qid") == "")), F.count_distinct("qid")).first()
    if not n:
        raise NoQueries("no queries")
    if bad:
        raise BadQueryId(f"{bad} queries have no id")
    if distinct < n:
        raise DuplicateQuery("a query id occurs twice")
    if qrels is not None and corpus is not None and not qrels.join(corpus.docs.select("doc"), "doc", "left_anti").isEmpty():
        raise ForeignDocument("a judgment names a document that isn't in the corpus")


def check_ranked(ranked: DataFrame) -> None:
    if not ranked.groupBy(*[c for c in ("arm", "qid", "doc") if c in ranked.columns]).count().where("count > 1").isEmpty():
        raise DuplicateRanked("a document is ranked twice for a query")


def ranked_by(arm: Arm, queries: DataFrame, k: int, made: Streams | None = None) -> DataFrame:
    """An arm's ranking: fetch k times over-fetch, keep k."""
    deep, made = k * arm.overfetch, made or Streams(queries)
    return arm.fuser([made.of(s, deep) for s in arm.scorers], deep).where(F.col("rank") <= k)


def evaluate(arms: list[Arm], queries: DataFrame, qrels: DataFrame, k: int, corpus=None) -> DataFrame:
    """(arm, qid, ndcg) for all arms and queries in one plan; a scorer that several arms share runs once.

    With ``corpus``, judgments of documents that it lacks are refused.
    """
    check(queries, arms, k, qrels, corpus)
    made, depth = Streams(queries), {}
    for a in arms:
        for s in a.scorers:
            depth[id(s)] = s, max(depth.get(id(s), (s, 0))[1], k * a.overfetch)
    for s, deep in sorted(depth.values(), key=lambda x: isinstance(x[0], GraphScorer)):  # seed scorers first
        made.of(s, deep)
    ranked = None
    for a in arms:
        rows = ranked_by(a, queries, k, made).withColumn("arm", F.lit(a.name))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    ranked = write_table(ranked, "ranked")
    check_ranked(ranked)
    out = None
    for a in arms:
        rows = ndcg(queries, ranked.where(F.col("arm") == a.name).drop("arm"), qrels, k).withColumn("arm", F.lit(a.name))
        out = rows if out is None else out.unionByName(rows)
    return out.select("arm", "qid", "ndcg")


def judged(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """The queries that have judgments (qid, doc, grade); a judgment of an unknown query is refused."""
    if not qrels.join(queries.select("qid"), "qid", "left_anti").isEmpty():
        raise UnknownQuery("a judgment names a query that isn't there")
    return queries.join(qrels.select("qid").distinct(), "qid", "left_semi")


def with_vectors(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Queries (qid, text) with their vectors (qid, text, vector): all have one of the same text and of one model, or it is refused."""
    found = vectors.select("qid", F.col("text").alias("_text"), F.col("vector").alias("_vector"))
    both = queries.join(found, "qid", "left")
    missing, other = both.agg(F.count_if(F.col("_vector").isNull()), F.count_if(F.col("_vector").isNotNull() & ~F.col("text").eqNullSafe(F.col("_text")))).first()
    if missing or other:
        raise UnmatchedVectors(f"{missing} queries have no vector, {other} one of another text")
    if "model" in vectors.columns and vectors.join(queries.select("qid"), "qid", "left_semi").select("model").distinct().count() > 1:
        raise UnmatchedVectors("vectors of several models")
    return both.withColumn("vector", F.col("_vector")).drop("_text", "_vector")


def summary(runs: DataFrame) -> DataFrame:
    """(arm, mean_ndcg, queries); a query that found nothing counts 0."""
    return runs.groupBy("arm").agg((ordered_sum(F.col("qid"), F.col("ndcg")) / F.count("*")).alias("mean_ndcg"), F.count("*").alias("queries"))


def paired(runs: DataFrame, base: str, arm: str) -> DataFrame:
    """(qid, delta) of two arms over the same queries."""
    a = runs.where(F.col("arm") == arm).select("qid", F.col("ndcg").alias("x"))
    b = runs.where(F.col("arm") == base).select("qid", F.col("ndcg").alias("y"))
    both = a.join(b, "qid", "full")
    if not both.where("x is null or y is null").isEmpty():
        raise Unpaired(f"{arm} and {base} have different queries")
    return both.select("qid", (F.col("x") - F.col("y")).alias("delta"))


def bootstrap(deltas: DataFrame, iterations: int) -> DataFrame:
    """One row: mean_delta, lo, hi (nearest-rank 2.5 % and 97.5 %), iterations, queries.

    Draws are hashes of iteration and place, so they repeat anywhere; queries are drawn in order of id.
    """
    if iterations <= 0:
        raise NoIterations("no iterations")
    spark = deltas.sparkSession
    # the paired queries are a stated set; one position each
    numbered = deltas.withColumn("i", F.row_number().over(Window.orderBy("qid")) - 1)
    n, mean = deltas.agg(F.count("*"), ordered_sum(F.col("qid"), F.col("delta")) / F.count("*")).first()
    grid = spark.range(iterations).select(F.col("id").alias("iter"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", "iter", "place")), 1, 8), 16, 10).cast("long") % n
    means = grid.withColumn("i", draw).join(F.broadcast(numbered.select("i", "delta")), "i").groupBy("iter").agg((ordered_sum(F.col("place"), F.col("delta")) / F.lit(float(n))).alias("m"))
    return means.agg(F.expr("percentile_disc(0.025) within group (order by m)").alias("lo"), F.expr("percentile_disc(0.975) within group (order by m)").alias("hi")).select(
        F.lit(mean).alias("mean_delta"), "lo", "hi", F.lit(iterations).alias("iterations"), F.lit(n).cast("int").alias("queries")
    )


def top_moves(deltas: DataFrame, n: int) -> DataFrame:
    """The n queries that changed most, by absolute change, then id."""
    return deltas.orderBy(F.desc(F.abs("delta")), "qid").limit(n)


def sweep(queries: DataFrame, qrels: DataFrame, base: list[DataFrame], more: list[DataFrame], k: int, constants: tuple[float, ...], overfetch: tuple[int, ...]) -> DataFrame:
    """(constant, overfetch, base_ndcg, arm_ndcg, delta_sign) over a grid, from streams fetched once at the greatest depth.

    All cells are one plan: each query and vote is repeated for the stated cells, and a cell's query is named by both.
    """
    cells = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(float(c)).alias("constant"), F.lit(m).alias("overfetch")) for side in (0, 1) for c in constants for m in overfetch])

    def spread(rows: DataFrame) -> DataFrame:
        return rows.withColumn("cell", F.explode(cells)).withColumn("qid", F.concat_ws("|", "cell.side", "cell.constant", "cell.overfetch", "qid"))

    votes = None
    for side, streams in enumerate((base, more)):
        for stream in streams:
            rows = spread(stream.select("qid", "doc", "rank")).where((F.col("cell.side") == side) & (F.col("rank") <= k * F.col("cell.overfetch")))
            votes = rows if votes is None else votes.unionByName(rows)
    votes = votes.withColumn("vote", F.lit(1.0) * (F.lit(1.0) / (F.col("cell.constant") + F.col("rank")))).where("vote <> 0")
    ranked = top_k(votes.groupBy("qid", "doc").agg(ordered_sum(F.col("rank"), F.col("vote")).alias("score")), k)
    asked = spread(queries.select("qid"))
    per = ndcg(asked, ranked, spread(qrels).drop("cell") if "qid" in qrels.columns else qrels, k)
    mean = per.join(asked, "qid").groupBy("cell").agg((ordered_sum(F.col("qid"), F.col("ndcg")) / F.count("*")).alias("v"))
    value = lambda side: F.max(F.when(F.col("cell.side") == side, F.col("v")))
    rows = mean.groupBy("cell.constant", "cell.overfetch").agg(value(0).alias("base_ndcg"), value(1).alias("arm_ndcg"))
    return rows.select("constant", "overfetch", "base_ndcg", "arm_ndcg", F.signum(F.round(F.col("arm_ndcg") - F.col("base_ndcg"), 12)).cast("int").alias("delta_sign"))


def sign_flips(grid: DataFrame) -> int:
    """How many cells of a sweep contradict its first non-zero sign."""
    rows = grid.orderBy("constant", "overfetch").select("delta_sign").collect()  # one row a cell
    signs = [r[0] for r in rows if r[0]]
    return sum(s != signs[0] for s in signs) if signs else 0


def tie_diagnostics(candidates: DataFrame, k: int) -> DataFrame:
    """How ties meet the cut at k, by query, from streams deeper than k.

    distinct_scores; tied (candidates with the score at rank min(k, n)); slots (of those, within
    the cut); excluded (of those, beyond it).
    """
    order = Window.partitionBy("qid").orderBy(*ranking())
    ranked = candidates.withColumn("rank", F.row_number().over(order))
    n = ranked.groupBy("qid").agg(F.count("*").alias("n"), F.count_distinct("score").alias("distinct_scores"))
    cut = ranked.join(n, "qid").where(F.col("rank") == F.least(F.lit(k), F.col("n"))).select("qid", F.col("score").alias("at_cut"), "n", "distinct_scores")
    tied = ranked.join(cut, "qid").where(F.col("score") == F.col("at_cut"))
    return tied.groupBy("qid", "n", "distinct_scores").agg(F.count("*").alias("tied"), F.count_if(F.col("rank") <= k).alias("slots"), F.count_if(F.col("rank") > k).alias("excluded"))


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """One row: recall (hits over wanted), worst (least of a query), worst_qid, queries."""
    hit = approximate.select("qid", "doc", F.lit(1).alias("hit"))
    per = exact.select("qid", "doc").join(hit, ["qid", "doc"], "left").groupBy("qid").agg(F.count("hit").alias("hits"), F.count("*").alias("want"))
    share = F.col("hits") / F.col("want")
    return per.agg((F.sum("hits") / F.sum("want")).alias("recall"), F.min(share).alias("worst"), F.min_by("qid", F.struct(share, F.col("qid"))).alias("worst_qid"), F.count("*").alias("queries"))


def truncated(stream: DataFrame, k: int) -> DataFrame:
    return top_k(stream, k)
