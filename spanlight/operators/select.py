"""From results to a package's items and omissions: signals, disqualification, ordering, greedy fill."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.errors import SettingsError
from spanlight.functions import text as T
from spanlight.model import ITEM, OMISSION, Budget

REDUNDANCY, DIVERSITY, FRESHNESS = 0.75, 0.7, 0.3
PRODUCER, DECLARED_CONFIDENCE = "spanlight.ingest/1", 0.5
DATE_KEYS = ("observed_at", "published", "date", "updated", "fetched_at")
CORPUS = "(corpus)"

UNCONFIRMED = "retrieval proposed this passage, but nothing of the question was confirmed in its text"
MOVED = "the recorded text is not at its offsets any more"
CHANGED_FILE = "the file was changed after it was read"
CHANGED_DOCUMENT = "the document was revised after it was indexed"


# --- columns ---


#: What (2k + 1) / 200 is with two digits, for each k: a tie in decimals that the binary number breaks either way.
_TIES = [round(float(f"{(2 * k + 1) / 200:.2f}") * 100) for k in range(100)]


def two_digits(part: Column, whole: Column) -> Column:
    """part / whole (0 to 1) with two digits, rounded as the binary number is; Spark's format_string rounds its decimal form half up."""
    m, n = part.cast("bigint"), whole.cast("bigint")
    k = F.floor(m * 100 / n)
    k = F.when(m * 100 < n * k, k - 1).when(m * 100 >= n * (k + 1), k + 1).otherwise(k).cast("int")
    over = m * 200 - n * (2 * k + 1)
    cents = F.when(over > 0, k + 1).when(over < 0, k).otherwise(F.get(F.array(*map(F.lit, _TIES)), F.least(k, F.lit(99))))
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def signals(section: Column, unconfirmed: Column, matched: Column, query: Column) -> Column:
    share = two_digits(F.least(matched, F.length(query)), F.length(query))
    return F.array_compact(
        F.array(
            F.lit("lexical_match"),
            F.when(section != "", "heading_match"),
            F.when(~unconfirmed, "confirmed_in_text"),
            F.when(~unconfirmed & (matched > 0) & (query != ""), F.concat(F.lit("confirmed_share:"), share)),
        )
    )


def disqualification(unconfirmed: Column, status: Column, fresh: Column) -> Column:
    """struct<rule, reason> of what may not be sent, by the first reason that holds; null for what may."""
    why = (
        F.when(unconfirmed, F.struct(F.lit("below_threshold"), F.lit(UNCONFIRMED)))
        .when(status == "unresolvable", F.struct(F.lit("stale_anchor"), F.lit(MOVED)))
        .when(~F.coalesce(fresh, F.lit(True)), F.struct(F.lit("stale_anchor"), F.lit(CHANGED_FILE)))
        .when(status == "stale", F.struct(F.lit("stale_anchor"), F.lit(CHANGED_DOCUMENT)))
    )
    return why.cast("struct<rule:string,reason:string>")


def provenance(metadata: Column) -> Column:
    """struct<layer, producer, observed_at, confidence> of a document's metadata; an unknown layer raises."""
    of = lambda k: F.element_at(metadata, k)
    dated = F.coalesce(*[F.when(F.trim(of(k)) != "", F.trim(of(k))) for k in DATE_KEYS])
    layer = F.coalesce(F.when(of("layer") != "", of("layer")), F.lit("fact"))
    checked = F.when(layer.isin("fact", "measure", "interpretation"), layer).otherwise(F.raise_error(F.concat(F.lit("unknown layer: "), layer)))
    sure = F.when(layer == "interpretation", F.coalesce(of("confidence").cast("double"), F.lit(DECLARED_CONFIDENCE)))
    producer = F.when(F.coalesce(of("layer"), F.lit("")) != "", F.coalesce(F.when(of("producer") != "", of("producer")), F.lit(PRODUCER))).otherwise(F.lit(PRODUCER))
    return F.struct(checked.alias("layer"), producer.alias("producer"), dated.alias("observed_at"), sure.alias("confidence"))


# --- orderings ---


def order_by_score(candidates: DataFrame) -> DataFrame:
    """candidates with place, from 0, best score first; ties by path, document and start."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "source_path", "document_id", "start")
    return candidates.withColumn("place", F.row_number().over(w) - 1)


def order_by_recency(candidates: DataFrame, freshness: float = FRESHNESS) -> DataFrame:
    """candidates with place: ranks by score and by date (ISO strings, latest first) blended; undated ones keep their score rank."""
    if not 0 <= freshness <= 1:
        raise SettingsError(f"freshness is a share from 0 to 1: {freshness}")
    ranked = order_by_score(candidates).withColumnRenamed("place", "by_score")
    dated = F.col("observed_at").isNotNull() & (F.col("observed_at") != "")
    by_date = W.partitionBy("query_id", dated).orderBy(F.desc("observed_at"), "by_score")
    rank = F.when(dated, F.row_number().over(by_date) - 1).otherwise(F.col("by_score"))
    blended = ranked.withColumn("by_date", rank).withColumn("blend", F.lit(1.0 - freshness) * F.col("by_score") + F.lit(freshness) * F.col("by_date"))
    w = W.partitionBy("query_id").orderBy("blend", "source_path", "document_id", "start")
    return blended.withColumn("place", F.row_number().over(w) - 1).drop("by_score", "by_date", "blend")


def _score_key(c: dict) -> tuple:
    return (-c["score"], c["source_path"], c["document_id"], c["start"])


def by_score(candidates: list[dict]) -> list[dict]:
    return sorted(candidates, key=_score_key)


def by_recency(candidates: list[dict], freshness: float = FRESHNESS) -> list[dict]:
    ranked = by_score(candidates)
    dated = [i for i, c in enumerate(ranked) if c["observed_at"]]
    newest = sorted(dated, key=lambda i: [0x10FFFF - ord(ch) for ch in ranked[i]["observed_at"]])
    place = {i: n for n, i in enumerate(newest)}
    return [ranked[i] for i in sorted(range(len(ranked)), key=lambda i: ((1 - freshness) * i + freshness * place.get(i, i), *_score_key(ranked[i])[1:]))]


def by_diversity(candidates: list[dict], diversity: float = DIVERSITY) -> list[dict]:
    """Maximal marginal relevance over scaled scores and shingle containment; the best score goes first."""
    left = by_score(candidates)
    if not left:
        return []
    scale = left[0]["score"] if left[0]["score"] > 0 else 1.0
    sets = [T.shingles(c["text"]) for c in left]
    worst = [0.0] * len(left)  # containment in what is chosen so far
    chosen, rest = [0], list(range(1, len(left)))
    while rest:
        for i in rest:
            worst[i] = max(worst[i], T.similarity(sets[i], sets[chosen[-1]])[0])
        pick = max(rest, key=lambda i: (diversity * (left[i]["score"] / scale) - (1 - diversity) * worst[i], -i))
        rest.remove(pick)
        chosen.append(pick)
    return [left[i] for i in chosen]


Ordering = Callable[[list[dict]], list[dict]]
ORDERINGS: dict[str, Ordering] = {"score": by_score, "recent": by_recency, "mmr": by_diversity}


def reranked(ordering: Ordering, score: Callable[[str, list[str]], Iterable[float]]) -> Ordering:
    """ordering, then a stable sort by score(query, texts): reorders, never admits."""

    def run(candidates: list[dict]) -> list[dict]:
        first = ordering(candidates)
        if not first:
            return first
        marks = list(score(first[0]["query"], [c["text"] for c in first]))
        return [c for _, _, c in sorted(zip([-m for m in marks], range(len(first)), first), key=lambda x: x[:2])]

    return run


def selected_ordering(name: str) -> Ordering:
    if name not in ORDERINGS:
        raise SettingsError(f"unknown ordering {name!r}: {', '.join(sorted(ORDERINGS))}")
    return ORDERINGS[name]


# --- greedy fill ---


def fit(candidates: list[dict], budget: Budget, minimum: float = 0.0, redundancy: float = REDUNDANCY, truncated_at: int | None = None) -> tuple[list[dict], list[dict], int]:
    """(items, omissions, spent) of ordered candidates, each of which ends up in one of both.

    First those that repeat no earlier one, in order, then the others; what doesn't fit is passed
    over, and filling goes on.
    """
    repeats = T.mark_duplicates([c["text"] for c in candidates], redundancy)
    items: list[dict] = []
    omissions: list[dict] = []
    id_at: dict[int, str] = {}
    spent = 0

    def omit(c: dict, rule: str, reason: str) -> None:
        omissions.append({"rule": rule, "reason": reason, **{k: c[k] for k in ("document_id", "start", "end", "source_path", "score", "cost")}})

    for i in [*(i for i in range(len(candidates)) if i not in repeats), *sorted(repeats)]:
        c, left = candidates[i], budget.remaining(spent)
        overlap = f"{repeats[i][1]:.0%} overlap" if i in repeats else ""
        if c["disqualified"] is not None:
            omit(c, c["disqualified"]["rule"], c["disqualified"]["reason"])
        elif c["score"] < minimum:
            omit(c, "below_threshold", f"its score of {c['score']:.3f} is under the minimum of {minimum:.3f}")
        elif not budget.fits(spent, c["cost"]) and i in repeats:
            omit(c, "redundant_candidate", f"{overlap} with {id_at.get(repeats[i][0], 'an earlier passage')}; the {left} {budget.unit} left would not hold it")
        elif not budget.fits(spent, c["cost"]):
            omit(c, "budget_exhausted", f"number {i + 1} in order; it costs {c['cost']} {budget.unit}, and {left} of {budget.limit} are left")
        else:
            marks = [f"redundant_with:{id_at.get(repeats[i][0], 'a passage that was not sent')}", overlap] if i in repeats else []
            spent += c["cost"]
            id_at[i] = f"itm_{len(items) + 1:03d}"
            items.append(
                {"item_id": id_at[i], "kind": "document_span", "rank": len(items) + 1, "signals": [*c["signals"], *marks]}
                | {k: c[k] for k in ("text", "document_id", "version", "start", "end", "text_hash", "source_path", "section", "provenance", "score", "cost")}
            )
    if truncated_at:
        omissions.append({"rule": "truncated_by_cap", "reason": f"retrieval stopped at its cap of {truncated_at} candidates; there may be more in the corpus", "document_id": CORPUS, "start": 0, "end": 0, "source_path": "", "score": None, "cost": None})
    return items, omissions, spent


FITTED = f"query_id string, query string, items array<{ITEM}>, omissions array<{OMISSION}>, spent int"


def fitted(candidates: DataFrame, budget: Budget, ordering: str | Ordering = "score", minimum: float = 0.0, redundancy: float = REDUNDANCY, truncated_at: int | None = None) -> DataFrame:
    """One row for each question: items, omissions and spent. A question has at most the candidate cap of rows, so one task holds it.

    candidates has query_id, query, text, document_id, version, start, end, text_hash, source_path,
    section, score, signals, provenance, disqualified, cost and capped.
    """
    order = selected_ordering(ordering) if isinstance(ordering, str) else ordering

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.to_dict("records")
        for r in rows:
            r["signals"] = list(r["signals"])
            r["observed_at"] = (r["provenance"] or {}).get("observed_at")
            r |= {k: int(r[k]) for k in ("start", "end", "cost")}
        capped = truncated_at if truncated_at and any(r["capped"] for r in rows) else None
        items, omissions, spent = fit(order(rows), budget, minimum, redundancy, capped)
        if len(items) + sum(o["rule"] != "truncated_by_cap" for o in omissions) != len(rows):
            raise AssertionError("a candidate was neither sent nor omitted")
        return pd.DataFrame([(rows[0]["query_id"], rows[0]["query"], items, omissions, spent)], columns=["query_id", "query", "items", "omissions", "spent"])

    return candidates.groupBy("query_id").applyInPandas(run, FITTED)


def filled(ordered: DataFrame, limit: int) -> DataFrame:
    """ordered(query_id, place, cost, …) with sent: the greedy fill alone.

    What was spent only grows, so of the rows of one cost those that are sent come first, and no more
    than limit / cost of them: only these are brought together, some limit x ln(limit) a question
    however many rows it has, and folded in the JVM. Rows without cost always fit.
    """
    fits = ordered.where((F.col("cost") > 0) & (F.col("cost") <= limit)).select("query_id", "place", "cost")
    nth = F.row_number().over(W.partitionBy("query_id", "cost").orderBy("place"))
    few = fits.withColumn("nth", nth).where(F.col("nth") * F.col("cost").cast("bigint") <= limit)
    each = few.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "cost"))).alias("c"))
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.array().cast("array<int>").alias("sent"))

    def step(acc: Column, x: Column) -> Column:
        room = acc["spent"] + x["cost"] <= limit
        return F.when(room, F.struct((acc["spent"] + x["cost"]).alias("spent"), F.concat(acc["sent"], F.array(x["place"])).alias("sent"))).otherwise(acc)

    sent = each.select("query_id", F.explode(F.aggregate("c", start, step, lambda a: a["sent"])).alias("place"), F.lit(True).alias("__sent"))
    out = ordered.join(sent, ["query_id", "place"], "left")
    return out.select(*ordered.columns, F.coalesce("__sent", F.col("cost") <= 0, F.lit(False)).alias("sent"))


# --- leads ---


def leads(packages: DataFrame, documents: DataFrame, limit: int = 1, only_when_empty: bool = True) -> DataFrame:
    """(query_id, rank, text, source_path, document_id, start, end, score, unconfirmed_because): the best omitted passages worth a look.

    From questions without items (or all), of unconfirmed and stale omissions with a score; texts
    are read from the current documents, blank ones skipped.
    """
    if limit <= 0:
        return packages.select("query_id").limit(0)
    some = packages.where(F.size("items") == 0) if only_when_empty else packages
    each = some.select("query_id", F.explode("omissions").alias("o")).select("query_id", "o.*").where(F.col("rule").isin("below_threshold", "stale_anchor") & F.col("score").isNotNull())
    met = each.join(documents.select("document_id", "content", F.col("source_path").alias("own_path")), "document_id")
    text = met.withColumn("text", F.substr("content", F.col("start") + 1, F.col("end") - F.col("start"))).where(F.col("text").rlike(r"\S"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "start")
    path = F.when(F.col("source_path") != "", F.col("source_path")).otherwise(F.col("own_path"))
    best = text.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return best.select("query_id", "rank", "text", path.alias("source_path"), "document_id", "start", "end", "score", F.col("reason").alias("unconfirmed_because"))
