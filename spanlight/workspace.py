"""A store, an index and a ledger below one root: the operations that the command line and the server share."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.config import Settings
from spanlight.errors import StorageError, UsageError
from spanlight.functions import columns as C
from spanlight.model import Budget
from spanlight.operators import anchors, ledger, retrieve, select, verify
from spanlight.operators.index import Index, sections_of
from spanlight.plans import context, package
from spanlight.sources import folder
from spanlight.sources.ingest import Store, ingest_folder


class Workspace:
    def __init__(self, spark: SparkSession, settings: Settings, index: str = "default") -> None:
        self.spark, self.settings = spark, settings
        names = settings.named_indexes()
        if index not in names:
            raise UsageError(f"no index named {index!r}: {', '.join(sorted(names))}")
        self.index_path = names[index]
        self.store = Store(spark, settings.store)
        self.ledger_path = f"{settings.store.rstrip('/')}/ledger"

    # --- corpus ---

    def ingest(self, root: str, rules: folder.IgnoreRules = folder.IgnoreRules()) -> DataFrame:
        """Statuses of a folder's files; the index learns what was added or revised, and is built whole the first time."""
        first = not self.store.parts()
        status = ingest_folder(self.spark, root, self.store, len(self.store.parts()), rules).persist()
        new = status.where("status in ('added', 'revised')").select(C.document_id(F.col("source_path")).alias("document_id"))
        if not new.isEmpty():
            if first:
                self.reindex()
            else:
                Index.revised(self.spark, self.index_path, new, sections_of(self.store.current().join(new, "document_id", "left_semi")))
        return status

    def reindex(self) -> None:
        Index.built(sections_of(self.store.current())).saved(self.index_path)

    def index(self) -> Index:
        if not self.store.parts():
            raise StorageError("nothing was ingested yet")
        return Index.opened(self.spark, self.index_path)

    def forget(self, paths: list[str]) -> int:
        """Every version of the documents of these paths; returns how many documents went."""
        gone = self.store.current().where(F.col("source_path").isin(paths)).select("document_id").persist()
        n = gone.count()
        if n:
            self.store.forget(gone)
            Index.revised(self.spark, self.index_path, gone, sections_of(self.store.versions().limit(0)))
        return n

    # --- questions ---

    def _asked(self, query: str) -> DataFrame:
        if not query.strip():
            raise UsageError("an empty question asks nothing")
        return self.spark.createDataFrame([("q", query)], "query_id string, query string")

    def search(self, query: str, limit: int | None = None) -> tuple[list[dict], bool]:
        """(results, whether the candidate cap was reached)."""
        s = self.settings
        rows, cut = retrieve.search(self._asked(query), self.store.versions(), self.index(), limit or s.limit, s.candidate_limit, retrieve.CONTEXT, s.confirmation())
        return [r.asDict(True) for r in rows.orderBy("rank").collect()], not cut.isEmpty()

    def context(self, query: str, budget: str | None = None, instructions: str = "default", root: str | None = None, at: str = "") -> dict[str, Any]:
        """A package, entered in the ledger. With root, files are compared with what was read."""
        s, b = self.settings, Budget.parse(budget or self.settings.budget)
        rules, schema = package.instruction_set(instructions)
        files = folder.walk(self.spark, root)[0] if root else None
        made = context.build(self._asked(query), self.store.versions(), self.index(), b, s.candidate_limit, s.context, s.minimum_score, s.redundancy, s.confirmation(), s.ordering, files, rules, schema, at).persist()
        text = made.select("json").first()[0]
        rows = made.withColumns({"created_at": F.lit(at), "unit": F.lit(b.unit), "budget_limit": F.lit(b.limit), "protected": F.lit(False), "seq": F.lit(0)})
        for name, part in zip(("entries", "items", "omissions"), ledger.opened(rows)):
            part.write.mode("append").parquet(f"{self.ledger_path}/{name}")
        return package.read_back(text)

    def leads(self, payload: dict[str, Any], limit: int = 1) -> list[dict]:
        rows = [(o["rule"], o["reason"], o["anchor"]["document_id"], o["anchor"]["start"], o["anchor"]["end"], o["anchor"]["source_path"], o.get("score"), o.get("cost")) for o in payload["omissions"]]
        omissions = [dict(zip(("rule", "reason", "document_id", "start", "end", "source_path", "score", "cost"), r)) for r in rows]
        shape = "query_id string, items array<string>, omissions array<struct<rule:string,reason:string,document_id:string,start:int,end:int,source_path:string,score:double,cost:int>>"
        p = self.spark.createDataFrame([("q", [i["item_id"] for i in payload["items"]], omissions)], shape)
        return [r.asDict() for r in select.leads(p, self.store.current(), limit).orderBy("rank").collect()]

    def trace(self, quotation: str, limit: int = 20) -> list[dict]:
        asked = self.spark.createDataFrame([("q", quotation)], "quotation_id string, quotation string")
        return [r.asDict() for r in anchors.trace_quotations(asked, self.store.current(), limit).orderBy("document_id", "start").collect()]

    def verify(self, payload: dict[str, Any], answer: str, at: str = "") -> dict[str, Any]:
        """A report on an answer, which also closes the package's ledger entry."""
        claims = verify.parse_answer(answer)
        pid = payload["package_id"]
        said = self.spark.createDataFrame([(pid, n, t, q) for n, (t, q) in enumerate(claims)], "package_id string, claim_no int, text string, citations array<string>")
        items = self.spark.createDataFrame([(pid, i["item_id"], i["anchor"]["document_id"], i["text"], i["anchor"]["start"]) for i in payload["items"]], "package_id string, item_id string, document_id string, text string, start int")
        shield = payload["provenance"].get("protection")
        shields = self.spark.createDataFrame([(pid, bool(shield["reversible"]))], "package_id string, reversible boolean") if shield else None
        classes, where = verify.verify(said, items, shields)
        out = [r.asDict() for r in classes.orderBy("claim_no").collect()]
        spots = [r.asDict() for r in where.orderBy("claim_no", "quote_no", "item_id", "start").collect()]
        counts = {k: sum(c["support"] == k for c in out) for k in ("supported", "unsupported", "uncited", "unverifiable")}
        self._close(pid, sorted({x["item_id"] for x in spots}), at)
        return {"package_id": pid, "counts": counts, "clean": bool(out) and counts["supported"] == len(out), "asserts_nothing": not out, "claims": out, "locations": spots}

    def _close(self, package_id: str, cited: list[str], at: str) -> None:
        try:
            entries, items = (self.spark.read.parquet(f"{self.ledger_path}/{n}") for n in ("entries", "items"))
        except Exception as e:  # nothing was opened here
            if "PATH_NOT_FOUND" in str(e):
                return
            raise
        done = self.spark.createDataFrame([(package_id, at or "closed")], "package_id string, verified_at string")
        spots = self.spark.createDataFrame([(package_id, c) for c in cited], "package_id string, item_id string")
        new = ledger.closed(entries, items, done, spots)
        for name, part in zip(("entries", "items"), new):
            part.write.mode("overwrite").parquet(f"{self.ledger_path}/{name}.new")
            self.spark.read.parquet(f"{self.ledger_path}/{name}.new").write.mode("overwrite").parquet(f"{self.ledger_path}/{name}")

    def usage(self, since: str | None = None) -> dict[str, Any]:
        parts = [self.spark.read.parquet(f"{self.ledger_path}/{n}").dropDuplicates(["package_id"] if n == "entries" else None) for n in ("entries", "items", "omissions")]
        return ledger.usage(*parts, since).first().asDict()

    def forget_ledger(self) -> int:
        """Empties the ledger; returns how many packages it had. Store and index stay."""
        try:
            n = self.spark.read.parquet(f"{self.ledger_path}/entries").select("package_id").distinct().count()
        except Exception as e:  # nothing was opened here
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.ledger_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.spark.catalog.clearCache()
        return n

    @classmethod
    def summaries(cls, spark: SparkSession, settings: Settings) -> list[dict[str, Any]]:
        """One row for each named index, in order, whether it opens or not: a broken one has only the kind of its error."""
        out = []
        for name in settings.named_indexes():
            try:
                made = Index.opened(spark, settings.named_indexes()[name])
                now = made.lengths.agg(F.countDistinct("document_id"), F.count("*")).first()
                out.append({"index": name, "documents": now[0], "sections": now[1], "unavailable": None})
            except Exception as e:
                out.append({"index": name, "documents": None, "sections": None, "unavailable": type(e).__name__})
        return out

    def doctor(self, root: str | None = None) -> dict[str, Any]:
        """Counts, revised documents, drifted files and formats."""
        versions = self.store.versions()
        out = {"documents": self.store.current().count(), "versions": versions.count(), "revised": versions.groupBy("document_id").count().where("count > 1").count(), "sections": self.index().count() if self.store.parts() else 0}
        if root:
            out["drifted"] = anchors.freshness(self.store.current(), folder.walk(self.spark, root)[0]).where("not is_current").count()
        return out


def to_text(payload: dict[str, Any]) -> str:
    return json.dumps(payload, ensure_ascii=False, sort_keys=True, indent=2)
