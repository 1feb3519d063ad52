"""Scoring packages against labelled cases, all cases in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.errors import UsageError
from spanlight.operators.index import small

FLOORS = {"evidence_recall": 0.95, "trap_rate": 0.20, "omission_correctness": 0.70}


def same_document(path: Column, key: Column) -> Column:
    """Whether a path is key or ends in it at a path boundary."""
    return (path == key) | F.endswith(path, F.concat(F.lit("/"), key))


def covered(items: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, fact_id), distinct: facts whose text is in an item, or whose span an item of their document contains.

    items: case_id, source_path, start, end, text; facts: case_id, fact_id, document, start, end, text.
    """
    # An item's text is compared with each text of its case once, however many facts have it.
    asked = facts.select("case_id", "text").distinct()
    said = items.select("case_id", F.col("text").alias("i_text")).join(small(asked), "case_id").where(F.contains(F.col("i_text"), F.col("text"))).select("case_id", "text").distinct()
    by_text = facts.join(said, ["case_id", "text"], "left_semi").select("case_id", "fact_id")
    # same_document() as an equation: a document is its path, or what follows a slash in it.
    parts = F.split("source_path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    i = items.select("case_id", F.col("start").alias("i_start"), F.col("end").alias("i_end"), F.explode(F.array_distinct(ends)).alias("document"))
    inside = facts.join(i, ["case_id", "document"]).where((F.col("i_start") <= F.col("start")) & (F.col("end") <= F.col("i_end"))).select("case_id", "fact_id")
    return by_text.unionByName(inside).distinct()


def relevant_items(items: DataFrame, facts: DataFrame) -> DataFrame:
    """items that overlap any fact of their case and document."""
    f = facts.select(F.col("case_id").alias("f_case"), "document", F.col("start").alias("f_start"), F.col("end").alias("f_end"))
    return items.join(f, (F.col("case_id") == F.col("f_case")) & same_document(F.col("source_path"), F.col("document")) & (F.col("start") < F.col("f_end")) & (F.col("f_start") < F.col("end")), "left_semi")


def dropping_rules(items: DataFrame, omissions: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, fact_id, rule): why a fact was not sent.

    `redundant_candidate` if an item marked as redundant is of the fact's document or of one with
    an equal fact; else the rule of an omission that overlaps the fact or its equal; else null.
    """
    twins = facts.alias("a").join(facts.alias("b"), (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.text") == F.col("b.text")))
    places = twins.select(F.col("a.case_id").alias("case_id"), F.col("a.fact_id").alias("fact_id"), F.col("b.document").alias("document"), F.col("b.start").alias("start"), F.col("b.end").alias("end"), (F.col("a.fact_id") == F.col("b.fact_id")).alias("own"))
    marked = items.where(F.exists("signals", lambda s: s.startswith("redundant_with:"))).select(F.col("case_id").alias("i_case"), F.col("source_path").alias("i_path"))
    again = places.join(marked, (F.col("case_id") == F.col("i_case")) & same_document(F.col("i_path"), F.col("document"))).select("case_id", "fact_id").distinct().withColumn("again", F.lit(True))
    o = omissions.select(F.col("case_id").alias("o_case"), F.col("source_path").alias("o_path"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), "rule", "place")
    hit = places.join(o, (F.col("case_id") == F.col("o_case")) & same_document(F.col("o_path"), F.col("document")) & (F.col("start") < F.col("o_end")) & (F.col("o_start") < F.col("end")))
    first = hit.groupBy("case_id", "fact_id").agg(F.min_by("rule", "place").alias("omitted_by"))
    out = facts.select("case_id", "fact_id").join(again, ["case_id", "fact_id"], "left").join(first, ["case_id", "fact_id"], "left")
    return out.select("case_id", "fact_id", F.when(F.col("again"), "redundant_candidate").otherwise(F.col("omitted_by")).alias("rule"))


def scored(cases: DataFrame, facts: DataFrame, items: DataFrame, rules: DataFrame, packages: DataFrame) -> DataFrame:
    """One row for each case: arrays found, missed, sprung, explained, misexplained; counts and flags.

    facts has must_include, must_not_include (booleans) and expected_rule; packages has case_id,
    spent, budget_limit, package_id and rebuilt_id.
    """
    hit = covered(items, facts).withColumn("hit", F.lit(True))
    f = facts.join(hit, ["case_id", "fact_id"], "left").join(rules, ["case_id", "fact_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    accountable = F.col("expected_rule").isNotNull()
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("fact_id"))))
    per = f.groupBy("case_id").agg(
        ids(F.col("must_include") & F.col("hit")).alias("found"),
        ids(F.col("must_include") & ~F.col("hit")).alias("missed"),
        ids(F.col("must_not_include") & F.col("hit")).alias("sprung"),
        F.count(F.when(F.col("must_not_include"), 1)).alias("forbidden"),
        ids(accountable & F.coalesce(F.col("rule") == F.col("expected_rule"), F.lit(False))).alias("explained"),
        ids(accountable & ~F.coalesce(F.col("rule") == F.col("expected_rule"), F.lit(False))).alias("misexplained"),
    )
    sent = items.groupBy("case_id").agg(F.count("*").alias("items"))
    good = relevant_items(items, facts).groupBy("case_id").agg(F.count("*").alias("relevant_items"))
    flags = packages.select("case_id", (F.col("spent") <= F.col("budget_limit")).alias("within_budget"), (F.col("package_id") == F.col("rebuilt_id")).alias("reproducible"))
    out = cases.join(per, "case_id", "left").join(sent, "case_id", "left").join(good, "case_id", "left").join(flags, "case_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("found", "missed", "sprung", "explained", "misexplained")} | {c: F.coalesce(c, F.lit(0)) for c in ("forbidden", "items", "relevant_items")})
    clean = (F.size("missed") == 0) & (F.size("sprung") == 0) & F.coalesce("within_budget", F.lit(True)) & F.coalesce("reproducible", F.lit(True))
    return out.withColumn("clean", clean)


def summarised(scores: DataFrame, by: tuple[str, ...] = ("genre", "language", "origin")) -> DataFrame:
    """Totals and rates over all cases and by each of `by` alone (grouping sets); rates without a base are null."""
    sizes = {"found": F.size("found"), "missed": F.size("missed"), "sprung": F.size("sprung"), "explained": F.size("explained"), "misexplained": F.size("misexplained")}
    flat = scores.select(*by, "clean", "forbidden", "items", "relevant_items", *[c.alias(k) for k, c in sizes.items()])
    sets = flat.groupingSets([[], *[[b] for b in by]], *by)
    out = sets.agg(
        F.count("*").alias("cases"), F.count(F.when(F.col("clean"), 1)).alias("clean_cases"), F.sum("found").alias("found"), F.sum(F.col("found") + F.col("missed")).alias("required"), F.sum("sprung").alias("sprung"),
        F.sum("forbidden").alias("forbidden"), F.sum("items").alias("items"), F.sum("relevant_items").alias("relevant_items"), F.sum("explained").alias("explained"), F.sum(F.col("explained") + F.col("misexplained")).alias("accounted"),
    )
    ratio = lambda a, b: F.col(a).cast("double") / F.nullif(F.col(b), F.lit(0))
    return out.withColumns({"evidence_recall": ratio("found", "required"), "evidence_precision": ratio("relevant_items", "items"), "trap_rate": ratio("sprung", "forbidden"), "omission_correctness": ratio("explained", "accounted")})


def breaches(summary: dict) -> list[str]:
    """Which floors a summary row breaks."""
    out = []
    for name, floor in FLOORS.items():
        value = summary.get(name)
        if value is not None and (value > floor if name == "trap_rate" else value < floor):
            out.append(f"{name} is {value:.1%}, the {'ceiling' if name == 'trap_rate' else 'floor'} {floor:.0%}")
    return out


#: Kinds of traps that hold the answer itself: citing one is citing the answer, and is only reported.
COPIES = ("near_duplicate",)


def answer_outcomes(answers: DataFrame, claims: DataFrame, locations: DataFrame, facts: DataFrame) -> DataFrame:
    """What became of each case's answer, from where its quotations were found.

    answers has case_id and readable; claims case_id, claim_no, citations and support; locations
    case_id, source_path, start and end of each quotation found; facts case_id, fact_id, document,
    start, end, must_include and trap_kind (null for facts that are no trap). A quotation is of every
    fact of its document that it overlaps, if only in part. Out come claims, grounded
    (some claim, and all supported), on_target (a required fact cited), abstained (claims, and none
    cites), captured (an adversary cited and no required fact), disagreeing (both), and the sorted
    fact_ids answers, adversaries, copies.
    """
    l = locations.select(F.col("case_id").alias("l_case"), "source_path", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    met = facts.join(l, (F.col("case_id") == F.col("l_case")) & same_document(F.col("source_path"), F.col("document")) & (F.col("start") < F.col("l_end")) & (F.col("l_start") < F.col("end")), "left_semi")
    copy = F.coalesce(F.col("trap_kind").isin(*COPIES), F.lit(False))
    ids = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("fact_id"))))
    cited = met.groupBy("case_id").agg(
        ids(F.col("trap_kind").isNull() & F.col("must_include")).alias("answers"), ids(F.col("trap_kind").isNotNull() & ~copy).alias("adversaries"), ids(copy).alias("copies")
    )
    said = claims.groupBy("case_id").agg(F.count("*").alias("claims"), F.every(F.col("support") == "supported").alias("grounded"), F.every(F.coalesce(F.size("citations"), F.lit(0)) <= 0).alias("abstained"))
    none = F.array().cast("array<string>")
    out = answers.select("case_id", "readable").join(said, "case_id", "left").join(cited, "case_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("grounded", "abstained")} | {c: F.coalesce(c, none) for c in ("answers", "adversaries", "copies")} | {"claims": F.coalesce("claims", F.lit(0))})
    target, adverse = F.size("answers") > 0, F.size("adversaries") > 0
    return out.withColumns({"on_target": target, "captured": adverse & ~target, "disagreeing": adverse & target})


def grounded_by(outcomes: DataFrame, by: str = "language") -> DataFrame:
    """(by, grounded, total) over readable answers."""
    return outcomes.where("readable").groupBy(by).agg(F.count(F.when(F.col("grounded"), 1)).alias("grounded"), F.count("*").alias("total"))


def answers_scored(answers: DataFrame) -> DataFrame:
    """One row of rates over answers(case_id, readable, grounded, on_target, captured, abstained); unreadable ones are in no base but their own."""
    n = lambda c: F.count(F.when(F.col("readable") & F.col(c), 1))
    base = answers.agg(F.count("*").alias("cases"), F.count(F.when(F.col("readable"), 1)).alias("readable"), *[n(c).alias(c) for c in ("grounded", "on_target", "captured", "abstained")])
    said = F.nullif(F.col("readable") - F.col("abstained"), F.lit(0))
    return base.withColumns({"grounded_rate": F.col("grounded").cast("double") / said, "on_target_rate": F.col("on_target").cast("double") / said, "captured_rate": F.col("captured").cast("double") / said, "abstained_rate": F.col("abstained").cast("double") / F.nullif(F.col("readable"), F.lit(0))})


def disagreements(outcomes: DataFrame) -> DataFrame:
    """(case_id, outcomes map<model, outcome>): cases whose outcome differs between models."""
    per = outcomes.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "outcome")))).alias("outcomes"), F.countDistinct("outcome").alias("n"))
    return per.where("n > 1").drop("n")


def strip_markup(text: str) -> tuple[str, dict[str, tuple[int, int]]]:
    """Text without {{F:id}}…{{/F}} marks, and the span of each fact in it; unbalanced, repeated and empty facts are refused."""
    out, facts, size, open_ = [], {}, 0, None
    rest = text
    while rest:
        a, b = rest.find("{{F:"), rest.find("{{/F}}")
        at = min(x for x in (a, b, len(rest)) if x >= 0)
        out.append(rest[:at])
        size += at
        if at == len(rest):
            break
        if at == a:
            end = rest.find("}}", a)
            if open_ is not None or end < 0:
                raise UsageError("a fact opens within another, or its mark never ends")
            open_, rest = (rest[a + 4 : end], size), rest[end + 2 :]
            if not open_[0] or open_[0] in facts:
                raise UsageError(f"a fact without a name of its own: {open_[0]!r}")
        else:
            if open_ is None or open_[1] == size:
                raise UsageError("a fact closes that never opened, or is empty")
            facts[open_[0]] = (open_[1], size)
            open_, rest = None, rest[b + 6 :]
    if open_ is not None:
        raise UsageError(f"fact {open_[0]!r} never closes")
    return "".join(out), facts
