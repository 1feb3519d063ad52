"""Language-model scores by compression: zstandard sizes under an in-domain and a general dictionary.

A compressor primed with a dictionary codes a text in about as many bits as a model of that
dictionary's text would need. Word counts over the whole corpus, and over its in-domain documents,
give each dictionary the words that save most. The general model knows the whole corpus, of which
no dictionary has room for more than the common words; so a text's general dictionary also gets
those of its sentences that occur in another document. The score is the normalised difference of
a text's sizes under both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.llm.common import held_out, materialize, table, unused

#: Bytes of a dictionary; bytes that are compressed at a time, so that long texts are scored by the dictionary too.
DICT_BYTES, WINDOW, LEVEL = 64 * 1024, 2048, 3
#: Code points at which a word (or a text without blanks) is cut; least words of a sentence that counts as repeated.
WORD_CHARS, SENTENCE_WORDS = 64, 8
#: Parts of the texts that have a sentence.
SALTS = 64
#: Classes of gain in an octave, and of words of about the same gain.
STEPS, SHARES = 8, 16

_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
_compressors: dict[bytes, zs.ZstdCompressor] = {}


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts: pre-aggregated in each task, so a frequent word is one row of it.

    Null texts have no words; words longer than WORD_CHARS count by their pieces. Repeated rows count as often as they occur.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(rf"\S{{1,{WORD_CHARS}}}"), F.lit(0))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def dictionary(counts: DataFrame, size: int = DICT_BYTES) -> bytes:
    """Words that occur more than once by the bytes they save, (length + 1 - 2) x count, the best last.

    Words are classed by gain and hash. The driver gets one row a class, picks the best classes that
    fit, and then their words, at most `size` bytes of them; an empty table gives blanks.
    """
    gain = (F.octet_length("word") - 1) * F.col("n")
    slot = F.floor(F.log2(gain + 1) * STEPS) * SHARES + F.pmod(F.xxhash64("word"), F.lit(SHARES))
    sized = counts.where("n > 1").select("word", gain.alias("gain"), (F.octet_length("word") + 1).alias("bytes"), slot.alias("slot"))
    least, left, last = None, size, None
    for r in sorted(sized.groupBy("slot").agg(F.sum("bytes").alias("bytes")).collect(), key=lambda r: -r.slot):  # 64 x STEPS x SHARES rows at most
        left -= r.bytes
        if left < 0:
            last = r
            break
        least = r.slot
    if least is None and last is None:
        return b" " * 8
    if least is None:  # even one class is too large: an even share of it
        chosen = sized.where(F.col("slot") == last.slot).where(F.pmod(F.xxhash64("word", F.lit(1)), F.lit(-(-last.bytes // size) * 2)) == 0)
    else:
        chosen = sized.where(F.col("slot") >= least)
    words = sorted(chosen.select("word", "gain").collect(), key=lambda r: (-r.gain, r.word))
    return b"".join(f" {r.word}".encode() for r in reversed(words))[-size:] or b" " * 8


def _compressor(dictionary_: bytes) -> zs.ZstdCompressor:
    how = zs.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(dictionary_), write_content_size=False, write_checksum=False, write_dict_id=False)
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(dictionary_, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=how)


def compressed_size(data: bytes, dictionary_: bytes, keep: bool = True) -> int:
    """Bytes of the compressed windows of data, without frame headers' sizes and checksums. keep: the dictionary is used again."""
    c = _compressors.get(dictionary_)
    if c is None:
        c = _compressor(dictionary_)
        if keep:
            if len(_compressors) >= 4:
                _compressors.clear()
            _compressors[dictionary_] = c
    return sum(len(c.compress(data[i : i + WINDOW])) for i in range(0, len(data), WINDOW))


# --- what the corpus has of a text ---


def sentences(text: str | None) -> list[bytes]:
    """Lower-case sentences of at least SENTENCE_WORDS words, shorter ones being anyone's; blanks don't matter."""
    out = []
    for m in _SENTENCE.finditer((text or "").lower()):
        words = m[0].split()
        if len(words) >= SENTENCE_WORDS:
            out.append(" ".join(words).encode("utf-8", "replace"))
    return out


def _digest(sentence: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(sentence, 7), "big", signed=True)


def repeated(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, found array<long>): of each text, by its hash, digests of the sentences that occur in another row of docs as well.

    Counts cover all rows. Texts without such a sentence are absent; a sentence that one row alone repeats doesn't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                own = {_digest(s) for s in sentences(t.as_py())}
                keys.extend([k] * len(own))
                found.extend(sorted(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.int64())], names=["key", "sentence"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    each = docs.where(F.length(f"`{text_col}`") > 0).select(F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(run, "key bigint, sentence bigint")
    by_text = materialize(each.groupBy("sentence", "key").agg(F.count("*").alias("n")), "sentences")  # copies of a text are one row
    # A sentence of many texts is counted and looked up in SALTS parts, whose sums meet in one small window.
    dealt = by_text.withColumn("part", F.pmod("key", F.lit(SALTS)))
    some = dealt.groupBy("sentence", "part").agg(F.sum("n").alias("n"))
    often = some.select("sentence", "part", F.sum("n").over(W.partitionBy("sentence")).alias("rows")).where("rows > 1").select("sentence", "part")
    return dealt.join(often, ["sentence", "part"], "left_semi").groupBy("key").agg(F.array_sort(F.collect_list("sentence")).alias("found"))


def scored(docs: DataFrame, general: bytes, domain: bytes, text_col: str = "text", out_col: str = "lm", known: DataFrame | None = None) -> DataFrame:
    """All columns of docs and out_col struct<n_bytes, general_bytes, domain_bytes, score>.

    score = (general - domain) / larger of both, above 0 for texts nearer to the domain; 0 for null
    and empty texts. The whole lower-cased text counts, and equal texts have equal scores. known is
    what repeated() finds in the corpus: those sentences of a text go into its general dictionary, so
    that texts that the corpus has elsewhere score far below 0. A column named as out_col is replaced.
    """
    found, key = unused(docs, "found__"), unused(docs, "key__")

    @F.pandas_udf("n_bytes bigint, general_bytes bigint, domain_bytes bigint, score double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, digests in batches:
            rows = []
            for t, own in zip(texts, digests):
                b = (t or "").lower().encode("utf-8", "replace")
                if own is not None and len(own):
                    of = set(map(int, own))
                    g = compressed_size(b, general + b" ".join([b"", *(s for s in sentences(t) if _digest(s) in of)]), keep=False)
                else:
                    g = compressed_size(b, general)
                d = compressed_size(b, domain)
                rows.append((len(b), g, d, (g - d) / max(g, d, 1)))
            yield pd.DataFrame(rows, columns=["n_bytes", "general_bytes", "domain_bytes", "score"])

    text = F.col(f"`{text_col}`")
    if known is None:
        both = docs.withColumn(found, F.lit(None).cast("array<bigint>"))
    else:  # dealt out by text at every size: what is known grows with the documents
        both = docs.withColumn(key, F.xxhash64(F.coalesce(text, F.lit("")))).join(known.select(F.col("key").alias(key), F.col("found").alias(found)).hint("merge"), key, "left").drop(key)
    return both.withColumn(out_col, score(text, F.col(found))).drop(found)


def in_domain(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents labelled as of good quality that may be learnt from.

    A document with several labels counts if one of them is good; null ids never do. Both sides are
    dealt out by id whatever their size: labels grow with the documents, so a broadcast of their ids
    would end with the input.
    """
    good = labels.where("quality = 1 and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id").distinct()
    return docs.join(good.hint("merge"), "doc_id", "left_semi")


def op8_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = [materialize(word_counts(x), "words") for x in (docs, in_domain(docs, table(spark, sf_dir, "labels")))]
    out = scored(docs, *map(dictionary, counts), known=materialize(repeated(docs), "repeated"))
    return out.select("doc_id", "lm.*")
