"""Running labelled cases: an index for each case, packages built twice, scores and floors."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.model import Budget
from spanlight.operators import evaluate, select
from spanlight.operators.index import Index, sections_of
from spanlight.plans import context
from spanlight.sources import adapters
from spanlight.sources.cases import load_cases


def _case_packages(documents: DataFrame, case: Any, **options: Any) -> DataFrame:
    mine = documents.where(F.col("case_id") == case.case_id)
    corpus = adapters.corpus(mine, F.col("source_path"), F.col("content")).withColumn("ingest_seq", F.lit(0).cast("bigint"))
    asked = documents.sparkSession.createDataFrame([(case.case_id, case.question)], "query_id string, query string")
    return context.build(asked, corpus, Index.built(sections_of(corpus)), Budget.parse(case.budget), **options)


def packages_of(documents: DataFrame, cases: DataFrame, **options: Any) -> DataFrame:
    """(case_id, items, omissions, spent, package_id, budget_limit): a package for each case over its own documents alone.

    Each case is a small corpus with statistics of its own, so cases are planned one by one.
    """
    out = None
    for case in cases.orderBy("case_id").toLocalIterator():
        made = _case_packages(documents, case, **options).select(F.col("query_id").alias("case_id"), "items", "omissions", "spent", "package_id").withColumn("budget_limit", F.lit(Budget.parse(case.budget).limit))
        out = made if out is None else out.unionByName(made)
    if out is None:
        raise ValueError("no cases")
    return out


def scores(spark: SparkSession, root: str, tier: str | None = None, split: str | None = None, **options: Any) -> DataFrame:
    cases, documents, facts = (t.persist() for t in load_cases(spark, root, tier, split))
    made = packages_of(documents, cases, **options).persist()
    again = packages_of(documents, cases, **options).select("case_id", F.col("package_id").alias("rebuilt_id"))
    items = made.select("case_id", F.explode("items").alias("i")).select("case_id", "i.*")
    omissions = made.select("case_id", F.posexplode("omissions").alias("place", "o")).select("case_id", "place", "o.*")
    rules = evaluate.dropping_rules(items, omissions, facts)
    return evaluate.scored(cases.select("case_id", "genre", "language", "origin"), facts, items, rules, made.join(again, "case_id"))


def evaluated(spark: SparkSession, root: str, tier: str | None = None, split: str | None = None, **options: Any) -> tuple[list[dict], list[str]]:
    """(summary rows, broken floors)."""
    table = [r.asDict() for r in evaluate.summarised(scores(spark, root, tier, split, **options)).collect()]
    whole = next(r for r in table if r["genre"] is None and r["language"] is None and r["origin"] is None)
    return table, evaluate.breaches(whole)


def first_fit(documents: DataFrame, limit: int) -> DataFrame:
    """Baseline: documents of each case in path order, while they fit; the question isn't read."""
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id").orderBy("source_path")
    rows = documents.select(F.col("case_id").alias("query_id"), "source_path", F.length("content").alias("cost")).withColumn("place", F.row_number().over(w) - 1)
    return select.filled(rows, limit).where("sent")


def no_confirm(candidates: DataFrame, documents: DataFrame, limit: int) -> DataFrame:
    """Baseline: the documents that the index proposes for each question, whole and in rank order, while they fit; nothing is confirmed.

    candidates has query_id, document_id and rank; documents document_id and content.
    """
    from pyspark.sql import Window as W

    first = candidates.groupBy("query_id", "document_id").agg(F.min("rank").alias("rank"))  # a document of several sections counts once
    w = W.partitionBy("query_id").orderBy("rank", "document_id")
    rows = first.join(documents.select("document_id", F.length("content").alias("cost")), "document_id").withColumn("place", F.row_number().over(w) - 1)
    return select.filled(rows, limit).where("sent")


def fitted_weights(counts: DataFrame, label: str = "tokens") -> dict[str, float]:
    """Least-squares weights of character classes for known token counts (a column for each class, and `label`)."""
    import numpy as np

    names = [c for c in counts.columns if c != label]
    sums = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"{a}__{b}") for i, a in enumerate(names) for b in names[i:]]
    sums += [F.sum(F.col(a).cast("double") * F.col(label).cast("double")).alias(f"{a}__y") for a in names]
    row = counts.agg(*sums).first().asDict()  # the normal equations are one row
    gram = np.array([[row[f"{a}__{b}"] if f"{a}__{b}" in row else row[f"{b}__{a}"] for b in names] for a in names])
    return dict(zip(names, np.linalg.lstsq(gram, np.array([row[f"{a}__y"] for a in names]), rcond=None)[0].tolist()))


def swept(spark: SparkSession, root: str, moves: dict[str, list[Any]]) -> list[dict]:
    """Summary rows of the cases with one setting moved at a time."""
    out = []
    for name, values in moves.items():
        for v in values:
            table, _ = evaluated(spark, root, **{name: v})
            whole = next(r for r in table if r["genre"] is None and r["language"] is None and r["origin"] is None)
            out.append({"setting": name, "value": str(v)} | whole)
    return out
