"""Column functions: JVM expressions where Spark has them, Arrow UDFs for NFKC, casefold and offset maps."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlight.errors import UsageError
from spanlight.functions import text as T

#: Texts of a batch that are Python strings at a time.
ROWS = 256
#: Characters that index tokens consist of.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
SEPARATORS = r" \t\n\r\x{3000}"
_RANGES = {k: "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in v) for k, v in T.SCRIPT_RANGES.items()}
#: Maximal runs of one script.
RUNS = "|".join([*(f"[{r}]+" for r in _RANGES.values()), f"[^{SEPARATORS}{''.join(_RANGES.values())}]+"])
_BIGRAMS = f"^[{_RANGES['ideograph']}]|^[{_RANGES['katakana']}]"


def _string(fn: Callable[[str], str | None]):
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        parts = [texts.slice(a, ROWS) for a in range(0, len(texts), ROWS)]  # so that few texts are Python strings at a time
        return pa.concat_arrays([pa.array([], pa.string()), *[pa.array([None if t is None else fn(t) for t in p.to_pylist()], pa.string()) for p in parts]])

    return run


def _strings(fn: Callable[[str], list[str]]):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fn(t))

    return run


def fold(text: Column | str) -> Column:
    """NFKC and casefold of the whole string."""
    return _string(T.nfkc_casefold)(text)


def search_form(text: Column | str) -> Column:
    return _string(T.search_text)(text)


def collapsed_fold(text: Column | str) -> Column:
    """Folded, white-space runs as one blank, trimmed: what shingles are cut from."""
    return _string(lambda t: " ".join(T.nfkc_casefold(t).split()))(text)


def needles(query: Column | str) -> Column:
    return _strings(T.needles)(query)


def content_terms(query: Column | str) -> Column:
    return _strings(T.content_terms)(query)


def query_terms(query: Column | str) -> Column:
    return _strings(T.query_terms)(query)


def script_runs(folded: Column) -> Column:
    """Runs of one script in a folded text."""
    return F.regexp_extract_all(folded, F.lit(RUNS), F.lit(0))


def index_terms(folded: Column) -> Column:
    """Terms of a folded text: bigrams of ideograph and Katakana runs, other runs whole."""

    def terms(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))
        return F.when(run.rlike(_BIGRAMS) & (F.length(run) > 1), pairs).otherwise(F.array(run))

    return F.flatten(F.transform(script_runs(folded), terms))


def index_tokens(folded: Column) -> Column:
    """The token stream of a folded text: its terms, split at everything but letters and numbers."""
    return F.flatten(F.transform(index_terms(folded), lambda t: F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))))


def trim_marks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^[\p{P}\p{S}]+", ""), r"[\p{P}\p{S}]+$", "")


def needle_runs(folded: Column) -> Column:
    """needles() of an already folded question, in the JVM."""
    whole = trim_marks(folded)
    words = F.filter(F.transform(F.split(F.trim(F.regexp_replace(whole, r"\s+", " ")), " "), trim_marks), lambda w: w != "")
    n = F.size(words)
    runs = F.flatten(
        F.transform(
            F.sequence(n, F.lit(2), F.lit(-1)),
            lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")),
        )
    )
    one = F.when(n == 1, words).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.when(n > 1, F.array_distinct(runs)).otherwise(one)


def shingle_set(collapsed: Column, size: int = 5) -> Column:
    """Distinct character windows of a collapsed, folded text."""
    windows = F.transform(F.sequence(F.lit(1), F.length(collapsed) - size + 1), lambda i: F.substr(collapsed, i, F.lit(size)))
    few = F.when(collapsed == "", F.array().cast("array<string>")).otherwise(F.array(collapsed))
    return F.when(F.length(collapsed) >= size, F.array_distinct(windows)).otherwise(few)


def grams(text: Column, size: int = 3) -> Column:
    """Distinct character windows; none for shorter texts. Cut from the array of characters, so in time linear in the text."""
    chars = F.split(text, "")

    def windows(c: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - size), lambda i: F.concat(*[F.get(c, i + k) for k in range(size)])))

    one = F.get(F.transform(F.array(chars), windows), F.lit(0))  # the characters are computed once
    return F.when(F.length(text) >= size, one).otherwise(F.array().cast("array<string>"))


def content_hash(text: Column, algorithm: str = "sha256") -> Column:
    """algorithm:hex of the text in UTF-8; null for null. blake2b, which Spark lacks, goes through Arrow."""
    if algorithm in ("sha256", "sha512"):
        return F.concat(F.lit(f"{algorithm}:"), F.sha2(text.cast("binary"), int(algorithm[3:])))
    if algorithm != "blake2b":
        raise UsageError(f"a hash is sha256, sha512 or blake2b: {algorithm!r}")
    return F.concat(F.lit("blake2b:"), _string(lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass")).hexdigest())(text))


def document_id(source_path: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(source_path.cast("binary"), 256), 1, 16))


def line_number(text: Column, offset: Column) -> Column:
    """1-based line of a code-point offset."""
    head = F.substr(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def all_positions(text: Column, needle: Column, limit: int = 1 << 30) -> Column:
    """Starts of all occurrences of needle, overlapping ones too."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None or w is None else T.occurrences(w, t, limit) for t, w in zip(texts, wanted)])

    return run(text, needle)


def confirmed(scoped: Column, needle_list: Column, terms: Column, settings: T.Confirmation) -> Column:
    """struct<spans array<struct<start,end>>, matched>: phrase confirmation, coverage where no phrase occurs."""

    @F.pandas_udf("spans array<struct<start:int,end:int>>, matched int")
    def run(texts: pd.Series, wanted: pd.Series, terms_: pd.Series) -> pd.DataFrame:
        out = []
        for t, n, c in zip(texts, wanted, terms_):
            spans, matched = T.confirm_phrase(t, list(n))
            if not spans:
                spans, matched = T.confirm_coverage(t, list(c), settings), 0
            out.append(([{"start": a, "end": b} for a, b in spans], matched))
        return pd.DataFrame(out, columns=["spans", "matched"])

    return run(scoped, needle_list, terms)


def widened(text: Column, start: Column, end: Column, context: int) -> Column:
    """struct<start,end> of the sentence around a span."""

    @F.pandas_udf("start int, end int")
    def run(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([T.widen(t, int(a), int(b), context) for t, a, b in zip(texts, starts, ends)], columns=["start", "end"])

    return run(text, start, end)


def quotation_spans(quotation: Column, text: Column) -> Column:
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(quotations: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in T.find_quotation(q or "", t or "")] for q, t in zip(quotations, texts)])

    return run(quotation, text)


# --- costs ---

#: Tokens for each character of a class; the classes of this table are its own, not the tokenizer's.
TOKEN_WEIGHTS = {
    "latin": 0.2151,
    "ideograph": 1.2923,
    "kana": 1.1919,
    "hangul": 1.2,
    "digit": 0.814,
    "space": 0.1601,
    "other": 0.484,
}
COST_CLASSES = {
    "kana": r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}]",
    "ideograph": r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}]",
    "hangul": r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]",
    "digit": r"\p{Nd}",
    "space": r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]",
    "latin": r"[\p{L}&&[\x{0}-\x{5FF}]]",
}
#: Error of the token estimate, measured against a public tokenizer.
MEASURED_ERROR = {"p50": 0.0495, "p95": 0.1828, "against": "cl100k_base"}


def script_counts(text: Column) -> Column:
    """struct of the number of characters in each cost class."""
    counts = {k: F.regexp_count(text, F.lit(p)) for k, p in COST_CLASSES.items()}
    other = F.length(text) - sum(counts.values(), F.lit(0))
    return F.struct(*[c.alias(k) for k, c in counts.items()], other.alias("other"))


def cost(text: Column, unit: str) -> Column:
    """Cost in characters, bytes or (estimated, half-even, 1 at least) tokens."""
    if unit == "characters":
        return F.length(text)
    if unit == "bytes":
        return F.octet_length(text)
    if unit != "tokens":
        raise ValueError(f"unknown unit {unit!r}: characters, bytes or tokens")
    counts = script_counts(text)
    total = sum((counts[k].cast("double") * F.lit(w) for k, w in TOKEN_WEIGHTS.items()), F.lit(0.0))
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.rint(total).cast("int")))
