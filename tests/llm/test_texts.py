import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlight.llm import fingerprints, language_id, lm_scoring, pii, toxicity
from spanlight.llm.common import held_out

LONG = "Many words stand here. " * 20_000


# --- fingerprints ---


def test_two_fingerprints_tell_their_difference():
    """Digests recovered from the two strings alone equal the sets' difference, however far apart the texts are."""
    random.seed(3)
    unit = lambda: "".join(random.choices("abcdefgh ", k=12)) + "."
    for n, m, both in ((0, 0, 0), (1, 0, 0), (3, 2, 40), (40, 50, 10), (900, 700, 300), (0, 0, 500), (2, 900, 1), (0, 60, 0)):
        common = [unit() for _ in range(both)]
        a, b = (" ".join([unit() for _ in range(k)] + common) for k in (n, m))
        x, y = (set(fingerprints.digests(t).tolist()) for t in (a, b))
        f, g = fingerprints.fingerprint(a), fingerprints.fingerprint(b)
        assert fingerprints.difference(f, g) == (x - y, y - x)
        assert fingerprints.likeness(f, g) == (len(x & y) / len(x | y) if x | y else 1.0)


def test_sketches_of_many_fold_and_peel():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in [0, 1, 2, 3, 5, 8, 13, 100, 1000] * 20]
    all_ = fingerprints.sketched(sets)
    assert all_.sizes().tolist() == [len(s) for s in sets] and (3 << all_.bits <= np.maximum(48, [8 * len(s) for s in sets])).all()
    owner, keys, sign, whole = all_.take(np.arange(len(sets))).peel()
    assert whole.all() and (sign == 1).all() and all(set(keys[owner == i].tolist()) == set(s.tolist()) for i, s in enumerate(sets))
    small = fingerprints.Sketches(np.full(1, 3))
    small.add(np.zeros(100, np.int64), sets[7])
    big = fingerprints.sketched([sets[7]]).folded(np.array([3]))
    assert (big.counts == small.counts).all() and (big.keys == small.keys).all() and (big.checks == small.checks).all()


def test_fingerprints_of_texts():
    f = fingerprints.fingerprint
    assert f("A b. C d.\nE") == f("A b.  C d.\n\n E ") and f("a.") != f("a. a.") and f(None) == f("")
    assert fingerprints.likeness(f("One. Two. Three."), f("One. Two. Four.")) == 0.5 and fingerprints.likeness(f(""), f("")) == 1.0
    words = " ".join(f"w{i}" for i in range(5000))
    assert 100 < len(fingerprints.paragraphs(words)) < 1500 and " ".join(fingerprints.paragraphs(words)) == words


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_compared(spark, partitions):
    random.seed(2)
    rows = [(i, "".join(random.choice("ab.é🙂 \n") for _ in range(random.randint(0, 50)))) for i in random.sample(range(1000), 60)]
    rows += [(5000, None), (5001, ""), (5002, LONG), (5002, "tie"), (None, "last of all")]
    rows += [(None, f"text {i}. of none") for i in range(40)] + [(7000, f"text {i}.") for i in range(40)] + [(7001, "same")] * 5
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, k int")
        got = fingerprints.compared(df).collect()
        assert fingerprints.compared(df.limit(0)).count() == 0
        alone = fingerprints.compared(df.where("doc_id = 5002 and text = 'tie'")).collect()
        hashes = {r.t: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = sorted(((i if i is not None else -(1 << 63), hashes[t or ""], t or "") for i, t in rows), reverse=True)
    want = []
    for n, (i, _, t) in enumerate(order):
        after = order[(n + 1) % len(order)][2]
        new = fingerprints.edited(t, after)
        sets = [set(fingerprints.digests(x).tolist()) for x in (t, new, after)]
        share = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        want.append((i if i != -(1 << 63) else None, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.fingerprint(t), fingerprints.fingerprint(new), *share))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key) and len(got) == len(rows)
    for r in got[:50]:
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
    assert alone[0].near_next == 1.0 and alone[0].edited_sha256 == hashlib.sha256(b"tit").hexdigest()


# --- language ---


def lingual(spark):
    random.seed(1)
    kinds = {"xx": "ba be bi bo zu za".split(), "yy": "tre cha ñol éau ique".split()}
    rows = [(i, " ".join("".join(random.choices(kinds[k], k=3)) for _ in range(30)), k) for i, k in ((i, "xy"[i % 2] * 2) for i in range(80))]
    return rows, spark.createDataFrame([(*r, "l") for r in rows], "doc_id bigint, text string, lang string, language string")


def test_languages(spark):
    rows, df = lingual(spark)
    odd = spark.createDataFrame([(900, None, None, ""), (901, "", "xx", ""), (902, "123 !!", "yy", ""), (903, LONG, None, ""), (904, "日本語", None, "")], df.schema)
    model = language_id.fit(df.union(odd))
    assert model.langs == ("xx", "yy")
    got = {r.doc_id: r.language for r in language_id.identified(df.union(odd), model).collect()}
    held = {r.doc_id for r in df.where(held_out(F.col("doc_id"))).collect()}
    assert held and all(got[i].lang == lang for i, _, lang in rows if i in held)
    assert all(0 <= x.score <= 1 for x in got.values())
    assert [got[i].lang for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang != "und" and got[904].lang in ("xx", "yy", "und")
    empty = language_id.fit(df.limit(0))
    assert empty.langs == () and language_id.identified(df, empty).first().language.lang == "und"
    relabelled = df.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert language_id.fit(relabelled) == language_id.fit(df)  # held-out labels teach nothing


def test_languages_equal_a_plain_version(spark):
    """Prototypes, predictions and scores recomputed letter by letter from the definition."""
    import math
    from collections import Counter

    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def letter(c):
        out = []
        for i in range(language_id.DIMS // 64):
            word = mixed((ord(c) * (language_id.DIMS // 64) + 1 + (language_id.SEED << 40) + i) * 0x9E3779B97F4A7C15 & mask)
            for byte in word.to_bytes(8, "little"):
                out += [2 * (byte >> (7 - k) & 1) - 1 for k in range(8)]
        return np.array(out)

    blank = letter("\0")

    def vector(text):
        t = "".join(c.lower()[:1] if c.isalpha() else "\0" for c in text)
        t = re.sub("\0+", "\0", f"\0{t}\0")
        n = Counter(g for g in (t[i : i + 3] for i in range(len(t) - 2)) if g.strip("\0"))
        of = lambda c: blank if c == "\0" else letter(c)
        return sum((math.sqrt(k) * np.roll(of(g[0]), 2) * np.roll(of(g[1]), 1) * of(g[2]) for g, k in n.items()), np.zeros(language_id.DIMS))

    random.seed(17)
    kinds = {"de": "der die das und ß für", "ja": "日本語 の 文字 ひらがな", "ru": "это русский текст", "x": "zu qe wi"}
    rows = [(i, " ".join(random.choices(kinds[k].split(), k=random.randint(1, 6))) + random.choice(["", "!", " 7"]), k if i % 11 else None) for i, k in ((i, sorted(kinds)[i % 4]) for i in range(90))]
    rows += [(900, "", None), (901, None, "x"), (902, "77 🙂", "ru")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learnt = {r.doc_id for r in df.where(~held_out(F.col("doc_id"))).collect()}
    sums = {}
    for i, t, lang in rows:
        if i in learnt and lang is not None and t is not None:
            sums[lang] = sums.get(lang, 0) + vector(t)
    prototypes = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}
    got = {r.doc_id: r.language for r in language_id.identified(df, language_id.fit(df)).collect()}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang, got[i].score) == ("und", 0.0)
            continue
        v = vector(t)
        cos = {k: p @ v / np.linalg.norm(v) for k, p in prototypes.items()}
        best = max(cos.values())
        assert cos[got[i].lang] > best - 1e-5
        assert abs(got[i].score - 1 / sum(math.exp(language_id.SHARPNESS * (c - cos[got[i].lang])) for c in cos.values())) < 1e-3


def test_many_languages(spark, monkeypatch):
    _, df = lingual(spark)
    whole = language_id.fit(df)
    monkeypatch.setattr(language_id, "HELD_LANGS", 1)
    parts = language_id.fit(df)
    assert whole.langs == parts.langs
    for a, b in zip(whole.prototypes, parts.prototypes):
        assert np.allclose(np.frombuffer(a, np.float32), np.frombuffer(b, np.float32), atol=1e-5)


def test_trigram_vectors_bind_rotated_letters():
    v = language_id._letters()
    code = 3 * language_id.SYMBOLS**2 + 5 * language_id.SYMBOLS + 7
    want = np.roll(v[3], 2) * np.roll(v[5], 1) * v[7]
    assert (language_id.trigram_vectors(np.array([code]))[0] == want).all()


def test_scripts_are_told_apart(spark, monkeypatch):
    random.seed(8)
    kinds = {"el": "αβγδεζηθικλμ", "he": "אבגדהוזחטיכל", "ja": "ひらがなのことばをしるす", "ko": "한국어글자를쓰는사람들", "ru": "абвгдежзийкл", "zh": "中文字符不同的語言學習"}
    rows = [(i, " ".join("".join(random.choices(kinds[k], k=4)) for _ in range(20)), k) for i, k in ((i, sorted(kinds)[i % 6]) for i in range(180))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(df)
    got = {r.doc_id: r.language.lang for r in language_id.identified(df, model).collect()}
    assert got == {i: k for i, _, k in rows}
    assert len({language_id._letters()[ord(c)].tobytes() for c in set("".join(kinds.values()))}) == len(set("".join(kinds.values())))
    assert not len(language_id.trigrams("🙂。「」")[0])
    monkeypatch.setattr(language_id, "HELD_TRIGRAMS", 10)
    for a, b in zip(model.prototypes, language_id.fit(df).prototypes):
        assert np.allclose(np.frombuffer(a, np.float32), np.frombuffer(b, np.float32), atol=1e-5)


# --- toxicity ---


def test_toxicity(spark):
    random.seed(6)
    plain = ["".join(random.choices(["an", "the", "or", "ing", "st", "re"], k=random.randint(1, 4))) for _ in range(300)]

    def text(bad):
        w = random.choices(plain, k=60)
        for _ in range(3 if bad else 0):
            w[random.randrange(60)] = random.choice(["grimble", "snorkfut"])
        return " ".join(w)

    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _ in rows] + [(900, None, "s", 0.5), (901, "", None, None), (902, LONG, "s", 0.1)], "doc_id bigint, text string, source string, toxicity_score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(3, 1, None), (None, 1, 1), (99999, 0, 1), (0, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.toxicity_score for r in toxicity.scored(docs, model).collect()}
    held = [r.doc_id for r in docs.where(held_out(F.col("doc_id"))).collect() if r.doc_id < 240]
    assert len(held) > 20 and all((got[i] >= 0.5) == (i % 3 == 0) for i in held)
    assert all(0 <= x <= 1 for x in got.values()) and got[900] == got[901] < 0.5 and len(got) == 243
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, flipped) == model
    none = toxicity.fit(docs.limit(0), labels)
    assert all(r.toxicity_score < 0.5 for r in toxicity.scored(docs, none).collect())
    assert toxicity.scored(docs.limit(0), none).count() == 0


def test_toxicity_equals_a_plain_scorer():
    """Distances recomputed from the definition, one window at a time, with compressors of their own."""
    random.seed(12)
    plain = ["".join(random.choices(["an", "the", "or", "ing", "st", "re"], k=random.randint(1, 4))) for _ in range(200)]
    docs = [" ".join(random.choices(plain, k=random.randint(0, 40)) + ["grimble"] * (i % 3 == 0)) for i in range(200)]
    model = toxicity.train([toxicity.windows(t) for t in docs[::3]], [toxicity.windows(t) for i, t in enumerate(docs) if i % 3])
    scorer = toxicity.Scorer(model)

    def size(words, dictionary):
        data = b" ".join(words) + toxicity._END
        return len(toxicity._compressor(dictionary).compress(data))

    def plainly(text):
        words, best = toxicity.units(text), 0
        of = lambda w: size(w, model.ordinary) - size(w, model.toxic) if w else 0
        for i in range(0, len(words), 8):
            if (d := of(words[i : i + 8])) > 0:
                best = max(best, d + max(of(words[max(0, i - 4) : i + 4]), of(words[i + 4 : i + 12])))
        return best

    odd = ["", None, "x" * 500, "日本語" * 100, "grimble", LONG[:3000]]
    assert [scorer.distance(t) for t in docs[:60] + odd] == [plainly(t) for t in docs[:60] + odd]
    assert b"".join(toxicity.units("ab " + "x" * 500)) == b"ab" + b"x" * 500  # long words whole
    assert toxicity.calibrated([(0, 0), (1, 0), (5, 1), (9, 1)]) == 3.5 and toxicity.calibrated([(3, 1)]) == toxicity.THRESHOLD


def test_toxicity_ties_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d"), (2, "e f"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0)], "doc_id bigint, toxic int")
    learnt = {r.doc_id for r in docs.where(~held_out(F.col("doc_id"))).collect()}
    bad, good = toxicity.sample(docs, labels)
    assert bad == ([[b"c d"]] if 1 in learnt else []) and good == ([[b"e f"]] if 2 in learnt else [])
    many = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40_000)))], docs.schema)
    assert [len(d) for x in toxicity.sample(many, labels) for d in x] == [toxicity.DOC_WINDOWS] * (1 in learnt)
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 5 and len({r.toxicity_score for r in got if r.text == "a b"}) == 1


# --- personal data ---

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        s = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and s % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def test_base_spans_equal_plain_scans(spark):
    random.seed(9)
    texts = ["".join(random.choice("a1@. -+()_é🙂0459b%") for _ in range(random.randint(0, 100))) for _ in range(1500)]
    texts += ["4111 1111 1111 1111 1.2.3.4.5.6.7.8 a@b.c_d@e.f +1 (269) 555-3296", "1" * 3000, "a." * 3000 + "@" + "b." * 3000 + "c", "+1" + " " * 3000, "0004111111111111111", "1 " * 3000 + "4111-1111-1111-1111", "", None, "256.1.1.1 007.1.1.1", LONG]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", pii.base_spans(F.col("t")).alias("s")).collect():
        t = texts[r.i] or ""
        assert [(x.kind, x.start, x.end) for x in r.s] == [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t) if valid(k, m[0])], t[:80]


def test_disclosing_terms_and_sanitising(spark):
    random.seed(4)
    word = lambda: "".join(random.choices("abcdefgh", k=6))
    near = [(i, f"{word()} {word()} Zanzifrax at me@x.org {word()} {i}") for i in range(9)]
    rest = [(100 + i, " ".join(word() for _ in range(30))) for i in range(900)]
    odd = [(2000, "the zanzifrax again"), (2001, None), (2002, ""), (2003, "me@x.org"), (2003, "me@x.org"), (None, "call +1 (269) 555-3296 or 10.0.0.1")]
    df = spark.createDataFrame([(*r, "p", 1) for r in near + rest + odd], "doc_id bigint, text string, pii string, term int")
    terms = pii.disclosing_terms(df).collect()
    assert [(r.term, r.together, r.texts) for r in terms] == [("zanzifrax", 9, 10)]
    got = {r.doc_id: r.pii for r in pii.with_spans(df).collect()}
    assert [(s.kind, s.start, s.end) for s in got[2000]] == [("term", 4, 13)] and got[2001] == got[2002] == [] and got[150] == []
    clean = {r.doc_id: (r.text, r.pii) for r in pii.sanitise(df).collect()}
    assert clean[2000] == ("the <TERM> again", "p") and clean[2003][0] == "<EMAIL>" and clean[None][0] == "call <PHONE> or <IP>" and clean[2001][0] is None
    assert clean[150][0] == dict(rest)[150] and pii.sanitise(df).columns == df.columns and pii.with_spans(df).count() == df.count()
    assert pii.with_spans(df.limit(0)).count() == 0


def test_words_near_an_entity_count_whatever_their_length(spark):
    long = [c * 28 for c in "abcdefghijk"]
    rows = [(f"far {' '.join(long[:5])} me@x.org {' '.join(long[5:10])} away or 10.0.0.1",), (" ".join(["no", "1.2.3.4.5", "+1 (269) 555-3296", "here"]),)]
    got = {(r.entity, r.term) for r in pii._nearby(spark.createDataFrame(rows, "text string"), "text").collect()}
    assert {t for e, t in got if e == "email:me@x.org"} == set(long[:10])
    assert {t for e, t in got if e.startswith("ip:10")} == {"away", *long[7:10]}  # `or` has two bytes; it counts all the same
    assert {t for e, t in got if e.startswith("phone")} == {"here"}


def test_disclosing_terms_equal_a_plain_count(spark):
    """All terms with their figures, recomputed text by text from the definitions."""
    import math
    from collections import defaultdict

    random.seed(31)
    names = ["Ada", "Bjørn", "李明", "Zoe", "of", "Quux"]
    mails = [f"u{i}@x.org" for i in range(4)]
    texts = [f"text {i} about {i % 9} things w{i % 40}" for i in range(1500)]
    for k, (n, m) in enumerate([(0, 0), (1, 1), (2, 2), (3, 3), (4, 0), (5, 1)]):
        texts += [f"a{i} says {names[n]} writes to {mails[m].upper() if i % 2 else mails[m]} on {i}" for i in range(2 + 2 * k)]
    texts += [f"{names[3]} alone {i}" for i in range(9)] + texts[-5:] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    distinct = {t or "" for t in texts}
    word = re.compile(r"[^\W_]+")
    near, has = defaultdict(set), defaultdict(set)
    for t in distinct:
        for w in {w.lower() for w in word.findall(t)}:
            has[w].add(t)
        tokens = [(m[0], "@" in m[0]) for m in re.finditer(PLAIN["email"].replace("(", "(?:") + r"|[^\W_]+", t)]
        for i, (m, entity) in enumerate(tokens):
            if entity:
                for w, other in tokens[max(0, i - 5) : i + 6]:
                    if not other and len(w.encode()) >= 3:
                        near["email:" + m.lower(), w.lower()].add(t)
    with_entity = defaultdict(set)
    for (e, _), ts in near.items():
        with_entity[e] |= ts
    least, want = math.log2(len(near) / pii.MOST_CHANCE), {}
    for (e, w), ts in near.items():
        k, n, share = len(ts) - 1, max(len(has[w]), len(ts), 2) - 1, len(with_entity[e]) / len(distinct)
        x = k / n
        bits = 0.0 if k <= 0 or x <= share else k * math.log2(x / share) + ((n - k) * (math.log2(1 - x) - math.log2(1 - share)) if k < n else 0)
        p = len(ts) / len(has[w])
        if len(ts) > 1 and p >= pii.LEAST_PROBABILITY and math.log2(p / share) >= pii.LEAST_BITS and bits >= least:
            want[w, e] = (len(ts), len(has[w]))
    got = {(r.term, r.entity): (r.together, r.texts) for r in pii.disclosing_terms(df).collect()}
    assert got == want and {w for w, _ in want} >= {"李明", "quux"} and "zoe" not in {w for w, _ in want}


def test_sanitised_texts_equal_a_plain_scan(spark):
    random.seed(13)
    rows = [("x" * 50 + "é🙂", [(random.choice("ab"), s, s + random.randint(1, 6)) for s in random.choices(range(46), k=k)]) for k in (0, 1, 2, 3, 5, 9, 20) for _ in range(10)]
    rows += [("word " * 4000, [("a", 5 * i, 5 * i + 4) for i in range(4000)]), ("w" * 3000, [("b", i, i + 2) for i in range(0, 2998)]), ("w" * 9000, [("b", 3 * i, 3 * i + 2 + 600 * (i == 255)) for i in range(0, 2700)])]
    df = spark.createDataFrame([(i, t, [(k, a, b, "") for k, a, b in s]) for i, (t, s) in enumerate(rows)], f"i int, t string, s {pii.SPANS}")
    for r in df.select("i", pii.sanitised(F.col("t"), F.col("s")).alias("x")).collect():
        text, spans = rows[r.i]
        want, at, kind, top = [], 0, None, 0
        for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
            if kind is None or a >= top:
                want.append(text[at:a])
                want.append(f"<{k.upper()}>")
                kind, top = k, b
            top = at = max(top, b)
        assert r.x == "".join(want) + text[at:], r.i


def test_many_spans_in_one_text(spark):
    text = " ".join(f"u{i}@x.org" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    n, clean = df.select(F.size(pii.base_spans(F.col("text"))), pii.sanitised(F.col("text"), pii.base_spans(F.col("text")))).first()
    assert n == 20_000 and clean == " ".join(["<EMAIL>"] * 20_000)


def test_disclosing_terms_of_few_texts(spark):
    rest = [f"text {i} of {i % 7} words {i * 31} here" for i in range(3000)]
    near = [f"{m} {w} a{i} b{i}" for i, (m, w) in enumerate([("Me@x.org", "Zan"), ("me@X.org", "zan"), ("me@x.org", "zan"), ("+1 269 555 3296", "李明"), ("+1 (269) 555-3296", "李明"), ("+12695553296", "李明"), ("you@x.org", "once")])]
    df = spark.createDataFrame([(t,) for t in rest + near], "text string")
    got = {(r.term, r.entity, r.together, r.texts) for r in pii.disclosing_terms(df).collect()}
    assert got == {("zan", "email:me@x.org", 3, 3), ("李明", "phone:12695553296", 3, 3)}


# --- language-model scores ---


def test_lm_scores(spark):
    a, b = " ".join(["alpha", "bravo"] * 50), " ".join(["yankee", "zulu"] * 50)
    rows = [(i, a if i % 2 else b, 1) for i in range(60)] + [(900, None, 1), (901, "", 1), (902, LONG, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lm int")
    counts = {r.word: r.n for r in lm_scoring.word_counts(docs.where("doc_id < 60")).collect()}
    assert counts == {"alpha": 1500, "bravo": 1500, "yankee": 1500, "zulu": 1500}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    mine = lm_scoring.in_domain(docs, labels)
    assert {r.doc_id % 2 for r in mine.collect()} == {1}
    general, domain = lm_scoring.dictionary(lm_scoring.word_counts(docs.where("doc_id % 2 = 0"))), lm_scoring.dictionary(lm_scoring.word_counts(mine))
    got = {r.doc_id: r.lm for r in lm_scoring.scored(docs, general, domain).collect()}
    assert got[1].score > 0 > got[2].score and got[900].score == got[901].score == 0.0 and got[902].n_bytes == len(LONG)
    assert lm_scoring.scored(docs.limit(0), general, domain).count() == 0 and lm_scoring.dictionary(lm_scoring.word_counts(docs.limit(0)))


def test_lm_scores_equal_a_plain_version(spark):
    """Everything again from the definitions: counts, classes of gain, repeated sentences, sizes."""
    import math
    from collections import Counter

    random.seed(21)
    vocabulary = ["".join(random.choices("abcdefgh", k=random.randint(1, 9))) for _ in range(300)]
    sentence = lambda: " ".join(random.choices(vocabulary, k=random.randint(3, 14))).capitalize() + random.choice([".", "!", "\n"])
    shared = [sentence() for _ in range(5)]
    texts = [" ".join([sentence() for _ in range(6)] + random.choices(shared, k=i % 2)) for i in range(80)]
    texts += [texts[3], texts[3], "x" * 500, "日本語" * 40, None, "", " . ", " ".join(["w"] * 3000)]
    rows = [(i, t, i % 3 % 2) for i, t in enumerate(texts)] + [(5, texts[5], 1), (None, "of no id", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    size = 900

    def dictionary(of):
        counts = Counter(w for t in of for w in re.findall(r"\S{1,64}", (t or "").lower()))
        hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in counts], "w string").selectExpr("w", "pmod(xxhash64(w), 16) h").collect()} if counts else {}
        gain = {w: (len(w.encode()) - 1) * n for w, n in counts.items() if n > 1}
        slots: dict = {}
        for w, g in gain.items():
            slots.setdefault(math.floor(math.log2(g + 1) * 8) * 16 + hashed[w], []).append(w)
        out, left = [], size
        for s in sorted(slots, reverse=True):
            left -= sum(len(w.encode()) + 1 for w in slots[s])
            if left < 0:
                break
            out += slots[s]
        return b"".join(f" {w}".encode() for w in sorted(out, key=lambda w: (-gain[w], w))[::-1]) or b" " * 8

    mine = [t for i, t, y in rows if y and i % 7]
    general, domain = dictionary([t for _, t, _ in rows]), dictionary(mine)
    assert lm_scoring.dictionary(lm_scoring.word_counts(docs), size) == general
    assert lm_scoring.dictionary(lm_scoring.word_counts(spark.createDataFrame([(t,) for t in mine], "text string")), size) == domain
    have = Counter(s for _, t, _ in rows for s in set(lm_scoring.sentences(t)))
    want = set()
    for i, t, _ in rows:
        b = (t or "").lower().encode()
        more = [s for s in lm_scoring.sentences(t) if have[s] > 1]
        sizes = []
        for d in (general + b" ".join([b"", *more]) if more else general, domain):
            c = lm_scoring._compressor(d)
            sizes.append(sum(len(c.compress(b[k : k + 2048])) for k in range(0, len(b), 2048)))
        want.add((i, len(b), *sizes, (sizes[0] - sizes[1]) / max(*sizes, 1)))
    got = lm_scoring.scored(docs, general, domain, known=lm_scoring.repeated(docs)).selectExpr("doc_id", "lm.*").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    by = {r.doc_id: r.score for r in got}
    assert by[3] == by[80] < min(by[k] for k in range(0, 80) if k not in (3, 5)) and any(have[s] > 2 for s in have)


def test_dictionary_of_one_large_class(spark):
    counts = spark.createDataFrame([(f"word{i:06d}", 2) for i in range(20_000)], "word string, n bigint")
    d = lm_scoring.dictionary(counts, 2000)
    assert 300 < len(d) <= 2000


def test_every_good_document_is_in_domain(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("a word").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 > 0).cast("int").alias("quality"))
    good = labels.where("quality = 1").where(~held_out(F.col("doc_id"))).count()
    mine = lm_scoring.in_domain(docs, labels.union(labels))
    assert good > 5000 and {r.word: r.n for r in lm_scoring.word_counts(mine).collect()} == {"a": good, "word": good}
    assert "BroadcastHashJoin" not in mine._jdf.queryExecution().executedPlan().toString()
