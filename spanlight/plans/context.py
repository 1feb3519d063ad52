"""Building packages for many questions, asking a model, and verifying its answers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlight import __version__
from spanlight.functions import columns as C
from spanlight.functions.text import Confirmation
from spanlight.model import Budget, Protection
from spanlight.operators import anchors, ledger, retrieve, select, store, verify
from spanlight.operators.index import Index
from spanlight.plans import package

CONTEXT, CANDIDATES = 400, 50
ESTIMATORS = {"characters": "characters/exact", "bytes": "bytes/exact", "tokens": "heuristic/scripts@1"}


def candidates(queries: DataFrame, documents: DataFrame, index: Index, unit: str, candidate_limit: int = CANDIDATES, context: int = CONTEXT, settings: Confirmation = Confirmation(), files: DataFrame | None = None) -> DataFrame:
    """Candidates of every question with signals, provenance, disqualification and cost; capped marks questions at the cap."""
    proposed = index.candidates(queries, candidate_limit).persist()  # read several times; the cap bounds it
    results, truncation = retrieve.searched(proposed, queries, documents, None, candidate_limit, context, settings)
    theirs = retrieve.of_candidates(documents, proposed, queries.count() * candidate_limit)  # other documents' contents are not moved
    now = store.current(theirs).select("document_id", F.col("version").alias("now"), F.col("content").alias("now_content"), F.col("metadata").alias("now_metadata"))
    met = results.join(now, "document_id", "left").join(queries.select("query_id", "query"), "query_id")
    fresh = F.lit(True)
    if files is not None:
        known = anchors.freshness(store.current(theirs), files).select("document_id", "is_current")
        met, fresh = met.join(known, "document_id", "left"), F.col("is_current")
    status = anchors.resolution(F.col("now_content"), F.col("now"), F.col("version"), F.col("start"), F.col("end"), F.col("text_hash"))["status"]
    capped = truncation.select("query_id", F.lit(True).alias("capped"))
    out = met.withColumns(
        {
            "signals": select.signals(F.col("section"), F.col("unconfirmed"), F.col("matched"), F.col("query")),
            "provenance": select.provenance(F.coalesce("now_metadata", F.expr("map()").cast("map<string,string>"))),
            "disqualified": select.disqualification(F.col("unconfirmed"), status, fresh),
            "cost": C.cost(F.col("text"), unit),
        }
    ).join(capped, "query_id", "left")
    return out.withColumn("capped", F.coalesce("capped", F.lit(False))).drop("now", "now_content", "now_metadata", "is_current")


def build(queries: DataFrame, documents: DataFrame, index: Index, budget: Budget, candidate_limit: int = CANDIDATES, context: int = CONTEXT, minimum: float = 0.0, redundancy: float = select.REDUNDANCY, settings: Confirmation = Confirmation(), ordering: str | select.Ordering = "score", files: DataFrame | None = None, instructions: dict[str, Any] | None = None, output_schema: dict[str, Any] | None = None, created_at: str = "", protection: Protection | None = None) -> DataFrame:
    """One package for each question: query_id, query, items, omissions, spent, json, package_id. Questions without candidates get an empty one."""
    found = candidates(queries, documents, index, budget.unit, candidate_limit, context, settings, files)
    fitted = select.fitted(found, budget, ordering, minimum, redundancy, candidate_limit)
    all_of = queries.select(F.col("query_id").cast("string").alias("query_id"), "query").join(fitted.drop("query"), "query_id", "left")
    types = dict(fitted.dtypes)
    whole = all_of.withColumns({"items": F.coalesce("items", F.array().cast(types["items"])), "omissions": F.coalesce("omissions", F.array().cast(types["omissions"])), "spent": F.coalesce("spent", F.lit(0))})
    state = store.corpus_state(store.current(documents)).first()[0]
    origin: dict[str, Any] = {"version": __version__, "corpus_state": state, "providers": ["table", "freshness/files@1" if files is not None else "freshness/unchecked"], "protection": None}
    if protection is not None:
        origin["protection"] = {"by": protection.by, "scope": protection.scope, "reversible": protection.reversible}
    error = C.MEASURED_ERROR if budget.unit == "tokens" else None
    return package.built(whole, budget, ESTIMATORS[budget.unit], origin, instructions, output_schema, error, created_at)


class Provider(Protocol):
    """A model that answers prompts. It is called on the driver, one package at a time."""

    def generate(self, prompt: str) -> str: ...


class Redactor(Protocol):
    name: str
    scope: str
    reversible: bool

    def protect(self, text: str) -> str: ...

    def restore(self, text: str) -> str: ...


def ask(queries: DataFrame, documents: DataFrame, index: Index, budget: Budget, provider: Provider, redactor: Redactor | None = None, at: str = "", **options: Any) -> dict[str, DataFrame]:
    """packages, answers, claims, locations, reports, entries, items of a batch of questions, asked and verified.

    A provider is a service: the driver sends one prompt after the other and holds one at a time.
    """
    instructions, schema = package.instruction_set("answering")
    protection = Protection(redactor.name, redactor.scope, redactor.reversible) if redactor is not None else None
    packages = build(queries, documents, index, budget, instructions=instructions, output_schema=schema, created_at=at, protection=protection, **options).persist()
    spark = queries.sparkSession
    answers = []
    for row in package.rendered(packages).select("package_id", "prompt").toLocalIterator():
        answers.append((row.package_id, provider.generate(redactor.protect(row.prompt) if redactor is not None else row.prompt)))
    said = verify.parsed_answers(spark.createDataFrame(answers, "package_id string, answer string")).persist()
    claims = said.where("error is null").select("package_id", F.posexplode("claims").alias("claim_no", "c")).select("package_id", "claim_no", "c.text", "c.citations")
    items = packages.select("package_id", F.explode("items").alias("i")).select("package_id", "i.*")
    shields = packages.select("package_id", F.lit(protection.reversible).alias("reversible")) if protection is not None else None
    classes, where = verify.verify(claims, items, shields, redactor.restore if redactor is not None and redactor.reversible else None)
    rows = packages.withColumns({"created_at": F.lit(at), "unit": F.lit(budget.unit), "budget_limit": F.lit(budget.limit), "protected": F.lit(protection is not None), "seq": F.lit(0)})
    entries, sent, omitted = ledger.opened(rows)
    entries, sent = ledger.closed(entries, sent, said.where("error is null").select("package_id", F.lit(at).alias("verified_at")), where)
    return {"packages": packages, "answers": said, "claims": classes, "locations": where, "reports": verify.report(classes, said.where("error is null")), "entries": entries, "items": sent, "omissions": omitted}


def scored_by(fn: Callable[[str, list[str]], list[float]], ordering: str = "score") -> select.Ordering:
    """An ordering reranked by a scorer."""
    return select.reranked(select.selected_ordering(ordering), fn)
