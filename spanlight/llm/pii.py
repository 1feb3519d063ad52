"""Personal data: base patterns and information-theoretic sanitisation, as DataFrame expressions alone.

Base spans (e-mail, IP, card, phone) are protected entities. Terms near them are counted over the
whole corpus: how many different texts have the term within a few words of an entity, against how
many have it at all. A term that is mostly found with one entity tells who is meant; terms whose
conditional probability and information about an entity exceed the disclosure thresholds, and whose
meetings with it chance doesn't explain, are protected too. Sanitising generalises entities to their kind and removes or generalises the terms.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.llm.common import all_of, materialize, table, unused

#: Kinds in the order of results. The patterns match what a scan from the left for the plain
#: patterns would: a match can only start where a run of its first class starts or the last match
#: ended, so lookbehinds and possessive loops keep the search linear in the text.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no span of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Words on each side of an entity that count as near; least length of a term (a letter of Chinese or Korean has three bytes).
NEAR_WORDS, LEAST_BYTES = 5, 3
#: Disclosure thresholds: P(entity | term), bits about the entity; pairs of the corpus that may pass by chance.
LEAST_PROBABILITY, LEAST_BITS, MOST_CHANCE = 0.75, 6.0, 0.05

#: Items of a text that are folded at a time.
PART = 256

SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
_WORD = r"[\p{L}\p{N}]+"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once: within a lambda, an expression is computed again for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _in_parts(items: Column, start: Column, step: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """A fold whose state grows by every item, in parts of PART items: step builds a part from an empty state,
    join puts a part's state behind all before it. So no long array is copied for each item."""
    return _let(items, lambda x: F.aggregate(_parts(x), start, lambda acc, part: join(acc, F.aggregate(part, start, step))))


def _parts(items: Column) -> Column:
    last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / PART).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * PART + 1, PART))


def _located(text: Column, pattern: Column, kind: str) -> Column:
    """Leftmost, non-overlapping matches with code-point offsets: gaps and matches alternate, so their lengths add up."""
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    steps = F.filter(F.zip_with(found, gaps, lambda m, gap: F.struct(F.length(gap).alias("gap"), m.alias("value"))), lambda x: x["value"].isNotNull())

    def span(start: Column, end: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span(start, end, x["value"]))).alias("out"))

    def join(acc: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda s: span(acc["at"] + s["start"], acc["at"] + s["end"], s["value"]))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    return _in_parts(steps, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")), step, join)["out"]


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(span: Column) -> Column:
    value = span["value"]
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (
        F.when(span["kind"] == "ip", value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(span["kind"] == "card", digits.between(13, 19) & _luhn(value))
        .when(span["kind"] == "phone", digits.between(9, 15))
        .otherwise(True)
    )


def base_spans(text: Column) -> Column:
    """All base spans, by kind, then start; kinds may overlap one another. Null texts have none."""
    none = F.array().cast(SPANS)
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[F.when(text.rlike(HINTS[k]), F.filter(_located(text, F.lit(p), k), _valid)).otherwise(none) for k, p in PATTERNS.items()])


def text_key(text: Column) -> Column:
    """Key of equal texts. Should two texts share it, they share terms to look for, nothing else."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _all_words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0)), F.lower)), _long)


def _long(term: Column) -> Column:
    return F.octet_length(term) >= LEAST_BYTES


def _entity(span: Column) -> Column:
    """kind:value, the same for all spellings of one value."""
    value = span["value"]
    same = (
        F.when(span["kind"] == "email", F.lower(value))
        .when(span["kind"] == "ip", F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", ""))
        .otherwise(F.regexp_replace(value, "[^0-9]", ""))
    )
    return F.concat(span["kind"], F.lit(":"), same)


def _surprise(together: Column, texts: Column, share: Column) -> Column:
    """Bits against chance: least -log2 P (Chernoff) that of `texts` texts with a term so many have an entity that `share` of all texts have.

    One meeting is left out on both sides, for only pairs that meet at all are looked at.
    """
    k, n = together - 1, F.greatest(texts, together, F.lit(2)) - 1
    x = k / n
    apart = F.when(k < n, (n - k) * (F.log2(1 - x) - F.log2(1 - share))).otherwise(0.0)
    return F.when((k > 0) & (x > share), k * F.log2(x / share) + apart).otherwise(0.0)


#: One pass over a text: entities (or what only looks like one) and words that aren't part of an address or number.
_TOKENS = "|".join([*PATTERNS.values(), r"(?<![\p{L}\p{N}@.+-])[\p{L}\p{N}]++(?![@+-])"])


def _token(value: Column) -> Column:
    """struct<kind, value>: kind null for words."""
    kind = reduce(lambda rest, k: F.when(value.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(rest), reversed(PATTERNS), F.lit(None).cast("string"))
    return F.struct(kind.alias("kind"), value.alias("value"))


def _nearby(docs: DataFrame, text_col: str) -> DataFrame:
    """(entity, term, key), distinct: terms among the NEAR_WORDS tokens on either side of an entity, in texts of that key.

    Tokens are whole words of any length and entities, in the order of the text; a text with many
    mentions costs in proportion to them.
    """
    seen = docs.select(F.col(text_col).alias("t"), text_key(F.col(text_col)).alias("key")).where(F.size(base_spans(F.col("t"))) > 0)
    tokens = F.transform(F.regexp_extract_all("t", F.lit(_TOKENS), F.lit(0)), _token)

    def mention(all_: Column, x: Column, i: Column) -> Column:
        around = F.slice(all_, F.greatest(F.lit(1), i - NEAR_WORDS + 1), F.lit(NEAR_WORDS + 1) + F.least(F.lit(NEAR_WORDS), i))
        words = F.transform(F.filter(around, lambda y: y["kind"].isNull()), lambda y: F.lower(y["value"]))
        return F.when(x["kind"].isNotNull() & _valid(x), F.struct(_entity(x).alias("entity"), F.array_distinct(words).alias("near")))

    mentions = _let(tokens, lambda all_: F.filter(F.transform(all_, lambda x, i: mention(all_, x, i)), lambda m: m.isNotNull()))
    each = seen.select("key", F.explode(mentions).alias("m"))
    return each.select("m.entity", "key", F.explode("m.near").alias("term")).where(_long(F.col("term"))).distinct()


def disclosing_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, entity, together, texts, probability, bits): terms that exceed the disclosure thresholds.

    together and texts count different texts of the whole corpus (copies of one count once), with
    term near the entity, and with the term at all. bits is log2 of P(entity | term) over P(entity).
    """
    near = materialize(_nearby(docs, text_col), "near")
    total = docs.select(text_key(F.col(text_col)).alias("key")).distinct().count() or 1
    pairs = near.select("entity", "term").distinct().count()
    least = math.log2(max(pairs, 1) / MOST_CHANCE)  # bits, so that of all pairs looked at fewer than MOST_CHANCE pass by chance
    of_entity = near.select("entity", "key").distinct().groupBy("entity").agg(F.count("*").alias("with_entity"))
    share = F.least(F.col("with_entity") / F.lit(total), F.lit(1.0))
    together = near.groupBy("entity", "term").agg(F.count("*").alias("together")).where("together > 1")  # of a single meeting chance is the whole account
    # A term is in at least as many texts as it is near any entity in, which bounds its probability and
    # its surprise from above: words that are found near many entities go before the corpus is searched for the rest.
    around = near.select("term", "key").distinct().groupBy("term").agg(F.count("*").alias("around"))
    possible = together.join(around, "term").where(F.col("together") >= LEAST_PROBABILITY * F.col("around")).join(of_entity, "entity")
    candidates = materialize(possible.where(_surprise(F.col("together"), F.col("around"), share) >= least).drop("around"), "together")
    terms = candidates.select("term").distinct()
    has = docs.select(text_key(F.col(text_col)).alias("key"), F.explode(_all_words(F.col(text_col))).alias("term")).join(terms, "term", "left_semi").distinct()
    texts = has.groupBy("term").agg(F.count("*").alias("texts"))
    p = F.col("together") / F.col("texts")
    scored = candidates.join(texts, "term").withColumn("probability", p).withColumn("bits", F.log2(p / share))
    passed = (F.col("probability") >= LEAST_PROBABILITY) & (F.col("bits") >= LEAST_BITS) & (_surprise(F.col("together"), F.col("texts"), share) >= least)
    return scored.where(passed).select("term", "entity", "together", "texts", "probability", "bits")


def with_spans(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """All columns of docs and out_col (replaced if there): base spans by kind and start, then spans of kind `term`.

    Terms are found as whole words in any case, in every text, and dropped where they touch a base
    span. Null texts count as empty. Rows stay rows, repeated ones included.
    """
    base, key, wanted = (unused(docs, n) for n in ("base_spans__", "text_key__", "text_terms__"))
    text = docs[f"`{text_col}`"]
    kept = all_of(docs, [c for c in docs.columns if c.lower() != out_col.lower()])
    terms = materialize(disclosing_terms(docs.select(text.alias("text")), "text").select("term").distinct(), "terms")
    none = F.array().cast(SPANS)
    out = docs.select(*kept, base_spans(text).alias(base), text_key(text).alias(key))
    if terms.isEmpty():
        return out.withColumn(out_col, F.concat(base, none)).drop(base, key)
    words = docs.select(text_key(text).alias(key), F.explode(_all_words(text)).alias("term")).join(terms, "term", "left_semi")
    hits = materialize(words.distinct().groupBy(key).agg(F.array_sort(F.collect_list("term")).alias(wanted)), "hits")
    found = out.join(hits, key, "left")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(wanted, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    spans = F.when(F.col(wanted).isNull(), none).otherwise(_located(body, F.coalesce(pattern, F.lit("(?!)")), "term"))
    apart = F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.withColumn(out_col, F.concat(base, apart)).drop(base, key, wanted)


def sanitised(text: Column, spans: Column) -> Column:
    """text with its spans replaced by their kind in angle brackets; spans that overlap go together, under the kind of the first (of equal starts the longest)."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    merged = "array<struct<start:int,end:int,kind:string>>"
    none = F.struct(F.lit(0).alias("at"), F.array().cast(merged).alias("out"))

    def until(out: Column, end: Column) -> Column:
        """out with the end of its last span moved."""
        last = F.element_at(out, -1)
        return F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end"), last["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        span, end = F.struct(s["start"].alias("start"), (-s["less"]).alias("end"), s["kind"].alias("kind")), F.greatest(acc["at"], -s["less"])
        out = F.when((F.size(acc["out"]) > 0) & (s["start"] < acc["at"]), until(acc["out"], end)).otherwise(F.concat(acc["out"], F.array(span)))
        return F.struct(end.alias("at"), out.cast(merged).alias("out"))

    def join(acc: Column, part: Column) -> Column:
        """The part's spans that start within the last one before them only move its end."""
        rest = F.filter(part["out"], lambda s: s["start"] >= acc["at"])
        within = F.filter(part["out"], lambda s: s["start"] < acc["at"])
        end = F.greatest(acc["at"], F.element_at(within["end"], -1))
        out = F.when((F.size(acc["out"]) > 0) & (F.size(within) > 0), F.concat(until(acc["out"], end), rest)).otherwise(F.concat(acc["out"], part["out"]))
        return F.struct(F.greatest(acc["at"], part["at"]).alias("at"), out.cast(merged).alias("out"))

    def stretch(all_: Column, i: Column) -> Column:
        """A part's spans, where the stretch of text with them begins, and that text: cut once, so that no span is looked up from the text's start."""
        begin = F.coalesce(F.get(all_, i * PART - 1)["end"], F.lit(0))
        some = F.slice(all_, i * PART + 1, PART)
        end = F.coalesce(F.get(all_, F.least((i + 1) * PART, F.size(all_)) - 1)["end"], begin)
        return F.struct(begin.alias("begin"), some.alias("spans"), _between(text, begin, end).alias("body"))

    def replaced(x: Column) -> Column:
        gap = lambda s, i: _between(x["body"], F.coalesce(F.get(x["spans"], i - 1)["end"], x["begin"]) - x["begin"], s["start"] - x["begin"])
        return F.array_join(F.transform(x["spans"], lambda s, i: F.concat(gap(s, i), F.lit("<"), F.upper(s["kind"]), F.lit(">"))), "")

    def whole(all_: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / PART).cast("int"))
        done = F.array_join(F.transform(F.transform(places, lambda i: stretch(all_, i)), replaced), "")
        return F.concat(done, _between(text, F.coalesce(F.get(all_, F.size(all_) - 1)["end"], F.lit(0)), F.length(text)))

    return _let(_in_parts(by_place, none, step, join)["out"], whole)


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, end - start)


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the same columns, its text sanitised; texts without spans (and null) stay as they are."""
    spans = unused(docs, "pii_spans__")
    out = with_spans(docs, text_col, spans)
    text = F.col(f"`{text_col}`")
    new = F.when(F.size(spans) == 0, text).otherwise(sanitised(text, F.col(spans)))
    return out.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.filter("pii", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in (*PATTERNS, "term")]
    base = F.filter("pii", lambda s: s["kind"] != "term")
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
