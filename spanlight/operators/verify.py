"""Checking that an answer's quotations occur in what was sent."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlight.errors import AnswerError, ProtectedError
from spanlight.functions import columns as C
from spanlight.operators.index import small


def parse_answer(payload: str) -> list[tuple[str, list[str]]]:
    """(claim, quotations) of a model's JSON answer.

    {"claims": [...]} or the list itself; a claim is a string or {"text", "citations"}; one code
    fence around it all is tolerated. Anything else is refused.
    """
    text = payload.strip()
    if text.startswith("```") and text.endswith("```") and len(text.splitlines()) > 1:
        payload = "\n".join(text.splitlines()[1:-1])
    try:
        data = json.loads(payload)
    except json.JSONDecodeError as e:
        raise AnswerError(f"not JSON: {e}") from e
    claims = data.get("claims") if isinstance(data, dict) else data
    if not isinstance(claims, list):
        raise AnswerError("expected a list of claims, alone or under the key claims")
    out = []
    for n, c in enumerate(claims, 1):
        if isinstance(c, str):
            c = {"text": c}
        if not isinstance(c, dict):
            raise AnswerError(f"claim {n} is neither a string nor an object")
        said, quoted = c.get("text"), c.get("citations") or []
        if not isinstance(said, str) or not said.strip():
            raise AnswerError(f"claim {n} says nothing")
        if not isinstance(quoted, list) or any(not isinstance(q, str) for q in quoted):
            raise AnswerError(f"claim {n} cites something that is not a string")
        out.append((said, list(quoted)))
    return out


def parsed_answers(answers: DataFrame) -> DataFrame:
    """answers(package_id, answer) with claims array<struct<text, citations>> and error (null if it could be read)."""

    @F.pandas_udf("claims array<struct<text:string,citations:array<string>>>, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append(([{"text": s, "citations": q} for s, q in parse_answer(t or "")], None))
            except AnswerError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["claims", "error"])

    return answers.withColumn("parsed", run("answer")).select("*", "parsed.claims", "parsed.error").drop("parsed")


def quotations(claims: DataFrame) -> DataFrame:
    """(package_id, claim_no, quote_no, quotation) of claims(package_id, claim_no, text, citations)."""
    return claims.select("package_id", "claim_no", F.posexplode("citations").alias("quote_no", "quotation"))


def located(quoted: DataFrame, items: DataFrame) -> DataFrame:
    """(package_id, claim_no, quote_no, item_id, document_id, start, end): where quotations occur in the items of their package.

    Equal up to per-character NFKC, casefolding and white space; offsets are the document's.
    """
    asked = quoted.withColumn("q_form", C.search_form(F.col("quotation"))).where("q_form <> ''")
    tokens = F.split("q_form", " ")
    # Tokens between the first and the last are whole tokens of any text that holds the quotation.
    inner = F.transform(F.slice(tokens, 2, F.greatest(F.lit(0), F.size(tokens) - 2)), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))
    asked = asked.withColumn("token", F.array_max(inner)["t"])
    held = items.select("package_id", "item_id", "document_id", "text", F.col("start").alias("item_start"), C.search_form(F.col("text")).alias("form"))
    words = held.select("package_id", "item_id", F.explode(F.array_distinct(F.split("form", " "))).alias("token"))
    near = asked.where("token is not null").join(words, ["package_id", "token"]).drop("token").join(held, ["package_id", "item_id"])
    # Quotations without such a token are looked up by their first three characters, shorter ones among all items of their package.
    rest = asked.where("token is null").drop("token")
    met = near
    if not rest.isEmpty():
        keys = rest.where(F.length("q_form") >= 3).withColumn("gram", F.substring("q_form", 1, 3))
        have = held.select("package_id", "item_id", F.explode(C.grams(F.col("form"))).alias("gram")).join(small(keys.select("package_id", "gram").distinct()), ["package_id", "gram"], "left_semi")
        found = keys.join(have, ["package_id", "gram"]).drop("gram").join(held, ["package_id", "item_id"])
        met = met.unionByName(found.select(near.columns)).unionByName(rest.where(F.length("q_form") < 3).join(held, "package_id").select(near.columns))
    met = met.where(F.contains(F.col("form"), F.col("q_form"))).drop("form", "q_form")
    likely = met.withColumn("spans", C.quotation_spans(F.col("quotation"), F.col("text"))).where(F.size("spans") > 0)
    each = likely.select("*", F.explode("spans").alias("s"))
    return each.select("package_id", "claim_no", "quote_no", "item_id", "document_id", (F.col("item_start") + F.col("s.start")).alias("start"), (F.col("item_start") + F.col("s.end")).alias("end"))


def classified(claims: DataFrame, quoted: DataFrame, locations: DataFrame, unverifiable: DataFrame | None = None) -> DataFrame:
    """claims with support: unverifiable (its package is listed), uncited, supported (every quotation found) or unsupported."""
    key = ["package_id", "claim_no"]
    hit = locations.select(*key, "quote_no").distinct().withColumn("hit", F.lit(1))
    per_claim = quoted.join(hit, [*key, "quote_no"], "left").groupBy(*key).agg(F.count("*").alias("n_quotes"), F.count("hit").alias("n_found"))
    out = claims.join(per_claim, key, "left")
    gone = F.lit(None).cast("boolean")
    if unverifiable is not None:
        out, gone = out.join(unverifiable.select("package_id").distinct().withColumn("gone", F.lit(True)), "package_id", "left"), F.col("gone")
    support = F.when(gone, "unverifiable").when(F.coalesce("n_quotes", F.lit(0)) == 0, "uncited").when(F.col("n_found") == F.col("n_quotes"), "supported").otherwise("unsupported")
    return out.withColumn("support", support).select(*claims.columns, "support")


def report(classes: DataFrame, packages: DataFrame) -> DataFrame:
    """One row for each package: the number of claims of each support, clean (one at least, all supported), asserts_nothing."""
    n = lambda s: F.count(F.when(F.col("support") == s, 1))
    kinds = ("supported", "unsupported", "uncited", "unverifiable")
    counts = packages.select("package_id").distinct().join(classes, "package_id", "left").groupBy("package_id").agg(*[n(k).alias(k) for k in kinds])
    total = sum((F.col(k) for k in kinds), F.lit(0))
    return counts.withColumns({"clean": (total > 0) & (F.col("supported") == total), "asserts_nothing": total == 0})


def verify(claims: DataFrame, items: DataFrame, protections: DataFrame | None = None, restore: Callable[[str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(classified claims, locations) of claims(package_id, claim_no, text, citations).

    protections(package_id, reversible) lists redacted packages: irreversible ones are unverifiable;
    for reversible ones quotations are restored first, and without restorer they are refused.
    """
    quoted = quotations(claims)
    lost = None
    if protections is not None:
        lost = protections.where("not reversible")
        quoted = quoted.join(lost.select("package_id"), "package_id", "left_anti")
        undo = protections.where("reversible").select("package_id")
        if restore is None:
            if not undo.isEmpty():
                raise ProtectedError("a package was redacted reversibly, and there is no restorer; its honest quotations would all look made up")
        else:
            back = _mapped(restore)
            mine = quoted.join(undo.distinct(), "package_id", "left_semi").withColumn("quotation", back("quotation"))
            quoted = quoted.join(undo.distinct(), "package_id", "left_anti").unionByName(mine)
    where = located(quoted, items)
    return classified(claims, quoted, where, lost), where


def _mapped(fn: Callable[[str], str]):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fn)

    return run
