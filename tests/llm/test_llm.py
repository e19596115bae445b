"""Dealt operators: brute force on small tables, held-out accuracy, and the defined cases."""

import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from oracle import check, connect

from recordforge.llm import ball_tree, chosen_path, components, gru, language, latent_decontam, line_templates, lm_scoring, mixing, quality, queries, textarrays, toxicity, url_rules
from recordforge.llm.labelled import labelled_rows, training_rows
from recordforge.sources import tables
from recordforge.sources.tables import load

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "doc_id long, text string, lang string, score string"
LONG = "word " * 30_000


def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, a clashing column."""
    return spark.createDataFrame([(1, "a plain text of words here", "en", "x"), (1, "a plain text of words here", "en", "x"), (2, None, "en", None), (3, "", None, "y"), (None, "no id at all in this row", "en", "z"), (4, LONG, None, None), (5, "  \n\t ", "fr", "q"), (6, "12 34 !?", "de", "q"), (7, "x\0y \0", "de", "q")], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    check(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name])


def held(key, parts, part):
    return zlib.crc32(str(key).encode()) % parts == part


# Texts as arrays


@settings(max_examples=80, deadline=None)
@given(st.lists(st.none() | st.text("ab é\n\0\U0001f600İ", max_size=12), min_size=1, max_size=5))
def test_words_are_those_of_a_regex(texts):
    powers = textarrays.Powers()
    codes, starts, lens = textarrays.encode(texts, lower=False)
    h, begin, end, first = textarrays.words(codes, starts, lens, textarrays.blank_table(), powers)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want]
    by_hash = defaultdict(set)
    for x, w in zip(h.tolist(), [x for w in want for x in w]):
        by_hash[x].add(w)
    assert all(len(s) == 1 for s in by_hash.values())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abc ", max_size=9), min_size=1, max_size=5), st.integers(1, 4))
def test_ngrams_do_not_depend_on_the_batch(texts, n):
    codes, starts, lens = textarrays.encode(texts)
    buckets, inside = textarrays.ngram_buckets(codes, starts, lens, n, 16)
    at = np.flatnonzero(inside)
    for i, t in enumerate(texts):
        alone, ok = textarrays.ngram_buckets(*textarrays.encode([t]), n, 16)
        assert buckets[at[textarrays.owners(at, starts) == i]].tolist() == alone[ok].tolist()
        assert ok.sum() == max(0, len(t) - n + 1)


# 1, 7: classifiers


@pytest.mark.parametrize("name, label, least", [("op1_toxicity", "toxic", 0.8), ("op7_quality", "quality", 0.9)])
def test_classifier_held_out(spark, name, label, least):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, d).collect()}
    assert len(got) == load(spark, d, "documents").count()
    assert all(r.held_out == held(k, 4, 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= (0.3 if label == "toxic" else 0.7)) for k, r in got.items())
    right = [got[r.doc_id].predicted == r[label] for r in load(spark, d, "labels").collect() if got[r.doc_id].held_out]
    assert np.mean(right) >= least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifier_defined_cases(spark, module):
    train = spark.createDataFrame([(f"good text {i}", 1) for i in range(20)] + [(f"zzz bad {i}", 0) for i in range(20)] + [(None, 0), ("x", None), ("", 1)], "text string, label int")
    model = module.fit(train, "text", "label")
    got = module.score(odd(spark), model)
    assert got.count() == 9 and dict(got.dtypes)["score"] == "double"
    rows = got.collect()
    assert len({r.score for r in rows if not r.text}) == 1 and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert module.score(empty(spark), model).count() == 0
    one = module.fit(train.filter("label = 1"), "text", "label")
    assert all(r.score > 0.99 for r in module.score(odd(spark), one).collect())
    none = module.fit(train.filter("label = 7"), "text", "label")
    assert module.score(odd(spark), none).count() == 9


MASK32, MASK64 = (1 << 32) - 1, (1 << 64) - 1


def plain_mix(h):
    """The same bijection of 64-bit numbers on Python's integers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = ((h ^ (h >> shift)) * factor) & MASK64
    return h ^ (h >> 31)


def plain_bucket(gram, bits):
    """A character n-gram's bucket, one character after the other."""
    h = len(gram) * 0x1B873593 & MASK32
    for k, c in enumerate(gram):
        h ^= h >> 15
        h = ((h + ord(c)) & MASK32) * textarrays.ODD32[k] & MASK32
    h ^= h >> 13
    return (h * textarrays.ODD32[5] & MASK32) >> (32 - bits)


def plain_word(w):
    return plain_mix(sum((ord(c) + 1) * pow(textarrays.BASE64, k, 1 << 64) for k, c in enumerate(w)) & MASK64)


PLAIN = ["", "good text 3", "zzz bad 7 zzz bad", "Ünïcode   words\nand lines", "a", "ab " * 40, "the the the end"]


def test_toxicity_score_is_the_sum_over_distinct_ngrams(spark):
    train = spark.createDataFrame([(f"good text {i}", 1) for i in range(20)] + [(f"zzz bad {i}", 0) for i in range(20)], "text string, label int")
    model = toxicity.fit(train, "text", "label")
    weight = dict(zip(model["chosen"].tolist(), model["weights"].tolist()))
    for r in toxicity.score(spark.createDataFrame([(t,) for t in PLAIN], "text string"), model).collect():
        t = r.text.lower()
        grams = {plain_bucket(t[i : i + n], model["bits"]) for n in model["orders"] for i in range(len(t) - n + 1)}
        assert math.isclose(r.score, 1 / (1 + math.exp(-model["bias"] - sum(weight.get(b, 0) for b in grams))), rel_tol=1e-5)


def test_quality_score_is_the_mean_over_features(spark):
    train = spark.createDataFrame([(f"good text {i}", 1) for i in range(20)] + [(f"zzz bad {i}", 0) for i in range(20)], "text string, label int")
    model = quality.fit(train, "text", "label")
    bits = model["bits"]
    for r in quality.score(spark.createDataFrame([(t,) for t in PLAIN], "text string"), model).collect():
        hashes = [plain_word(w) for w in re.findall(r"[^\t\n\v\f\r ]+", r.text)]
        pairs = [plain_mix((a * textarrays.ODD64[0] + b * textarrays.ODD64[1]) & MASK64) for a, b in zip(hashes, hashes[1:])]
        rows = [h >> (64 - bits) for h in hashes + pairs] + [plain_bucket(r.text[i : i + n], bits) for n in model["orders"] for i in range(len(r.text) - n + 1)]
        z = model["bias"] + sum(float(model["logit"][b]) for b in rows) / max(1, len(rows))
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-4)


def test_language_is_the_nearest_centroid(spark):
    train = spark.createDataFrame([("the cat and the dog " * (i % 3 + 1), "en") for i in range(9)] + [("el gato y la perra " * (i % 4 + 1), "es") for i in range(9)], "text string, lang string")
    model = language.fit(train, "text", "lang")
    size = 1 << model["bits"]
    for r in language.predict(spark.createDataFrame([(t,) for t in PLAIN], "text string"), model).collect():
        t = "".join(c if c.isalpha() else " " for c in r.text.lower())
        n = Counter(plain_bucket(t[i : i + k], model["bits"]) for k in model["orders"] for i in range(len(t) - k + 1))
        v = np.zeros(size)
        for b, c in n.items():
            v[b] = math.log1p(c) * model["idf"][b]
        cosine = model["centroids"] @ v / max(np.linalg.norm(v), 1e-12)
        if any(map(str.isalpha, r.text)):
            best = {name for name, c in zip(model["langs"], cosine) if c >= cosine.max() - 1e-5}
            assert r.lang_pred in best and math.isclose(r.score, min(1, max(0, cosine.max())), abs_tol=1e-4)
        else:
            assert (r.lang_pred, r.score) == ("und", 0)


def test_language_sample_is_of_distinct_texts_and_ties_go_to_the_first(spark):
    copies = spark.createDataFrame([("same words again", "b")] * 3000 + [("same words again", "a"), ("same words again", "c")], "text string, lang string")
    model = language.fit(copies, "text", "lang", per_language=1)
    assert model["langs"] == ["a", "b", "c"] and np.allclose(model["centroids"][0], model["centroids"][1])
    assert {r.lang_pred for r in language.predict(spark.createDataFrame([("same words",)], "text string"), model).collect()} == {"a"}


def test_labelled_rows_of_repeated_ids_stay_bounded(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i // 5}") for i in range(500)] + [(None, "x"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(5)] + [(3, 1), (3, 0), (None, 1), (4, None)], "doc_id long, y int")
    got = [(r.text, r.label) for r in training_rows(docs, labels, "y", 4, 9, 1000).collect()]
    assert len(got) == 5 and {g for g in got if g[0] is not None} == {("text 0", 0), ("text 0", 1)}
    assert len(got) == 5 and training_rows(docs, labels.limit(0), "y", 4, 9, 1000).count() == 0


def test_training_rows_leave_the_held_out(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("y"))
    got = [int(r.text) for r in training_rows(docs, labels, "y", 4, 2, 1000).collect()]
    assert sorted(got) == [i for i in range(200) if not held(i, 4, 2)]
    assert 20 <= training_rows(docs, labels, "y", 4, 2, 50).count() <= 80


# 2: line templates


def brute_templates(docs):
    def keys(line):
        if not line.strip():
            return []
        tokens = re.split(r"\s+", re.sub("[0-9]+", "<*>", line.strip(" ")))
        n = len(tokens)
        if n < 5:
            return [(n, -2, line.strip(" "), ())]
        if n < 8:
            return [(n, -1, tuple(tokens), ())]
        w = math.ceil((n - 3) / 4)
        return [(n, s, tuple(tokens[: 3 + w * s]), tuple(tokens[3 + w * (s + 1) :])) for s in range(4)]

    first = {}
    for i, text in docs:
        for line in text.split("\n"):
            for k in keys(line):
                first[k] = min(first.get(k, i), i)
    return {i: "\n".join(line for line in text.split("\n") if all(first[k] >= i for k in keys(line))) for i, text in docs}


def test_line_templates_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta".split())
    frames = ["user {} logged in from host {} at port {} with key ok", "copyright {} by the example company all rights", "short line"]
    docs = [(i, "\n".join(rng.choice(frames).format(rng.randint(0, 9), word(), rng.randint(0, 99)) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 14))) for _ in range(6))) for i in range(60)]
    got = line_templates.drop_recurring(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute_templates(docs)
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_lines == 6 and (r.n_dropped > 0) == (dict(docs)[r.doc_id] != r.text) for r in got)


def test_line_templates_defined_cases(spark):
    clashing = odd(spark).withColumns({c: F.lit("clash") for c in ("n_lines", "_hash", "_gone", "_gone_id", "_dropped")})
    got = line_templates.drop_recurring(clashing)
    assert got.columns == [c for c in clashing.columns if c != "n_lines"] + ["n_lines", "n_dropped"] and {r._gone for r in got.collect()} == {"clash"}
    short = spark.createDataFrame([(1, "All rights reserved.\n\nin 12"), (2, "All rights reserved.\n\nin 13\n \t")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_templates.drop_recurring(short).collect()} == {1: "All rights reserved.\n\nin 12", 2: "\nin 13\n \t"}
    assert got.count() == 9 and [r.text for r in got.collect() if r.doc_id == 1] == ["a plain text of words here"] * 2
    assert [(r.text, r.n_lines) for r in got.collect() if r.doc_id == 2] == [(None, 0)]
    assert line_templates.drop_recurring(empty(spark)).count() == 0
    passage = " ".join(f"w{'abcdefghij'[i % 10]}{'klmno'[i % 5]}" for i in range(60))
    two = spark.createDataFrame([(1, f"own one\n{passage}"), (2, f"{passage}\nown two")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_templates.drop_recurring(two).collect()} == {1: f"own one\n{passage}", 2: "own two"}


# 3: mixing


def brute_rates(t, p, targets):
    """The same projected gradient, in numpy."""
    total = t.sum()
    natural = np.maximum((t[:, None] * p).sum(0) / total, 1e-9)
    gram = (p * t[:, None]).T @ p / total
    bound = (gram / np.sqrt(np.outer(natural, natural))).sum(1).max()
    r, shares = np.ones(len(t)), natural
    for _ in range(mixing.STEPS):
        if np.abs(shares - targets).max() < mixing.TOLERANCE:
            break
        r = np.maximum(0, r - p @ ((shares - targets) / natural / bound))
        shares = (t[:, None] * p * r[:, None]).sum(0) / total
    return r, shares


def test_mixing_meets_targets_and_equals_numpy(spark):
    rng = random.Random(3)
    say = {"a": "red green blue cyan".split(), "b": "one two three four".split()}
    docs = [(i, " ".join(rng.choice(say["a" if i % 4 else "b"]) for _ in range(rng.randint(3, 40)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labelled = df.filter("doc_id < 40").withColumn("domain", F.when(F.col("doc_id") % 4 == 0, "b").otherwise("a"))
    got = mixing.mix(df, labelled, {"a": 0.5, "b": 0.5}).orderBy("doc_id").collect()
    t, p, r = np.array([x.n_tokens for x in got], float), np.array([x.posterior for x in got]), np.array([x.rate for x in got])
    assert [x.n_tokens for x in got] == [len(x.split()) for _, x in docs]
    assert np.allclose(p.sum(1), 1) and (r >= 0).all() and np.mean([x.domain == ("a" if x.doc_id % 4 else "b") for x in got]) == 1
    want, _ = brute_rates(t, p, np.array([0.5, 0.5]))
    assert np.allclose(r, want, atol=1e-6)
    assert np.abs((t[:, None] * p * r[:, None]).sum(0) / t.sum() - 0.5).max() < 1e-4
    assert all(abs(x.copies - x.rate) < 1 for x in got)


def test_mixing_posteriors_are_naive_bayes(spark):
    say = {"a": "red green blue cyan pink", "b": "one two three four red"}
    rows = [(i, " ".join(random.Random(i).choices(say["ab"[i % 2]].split(), k=i % 60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = df.filter("doc_id < 20").withColumn("domain", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    words = sorted({w for t in say.values() for w in t.split()})
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    n = {d: Counter(bucket[w] for i, t in rows[:20] if "ab"[i % 2] == d for w in t.split()) for d in "ab"}
    like = {d: lambda w, d=d: math.log((n[d][bucket[w]] + 0.1) / (n[d].total() + 0.1 * mixing.BUCKETS)) for d in "ab"}
    for r in mixing.mix(df, labelled, {"a": 1, "b": 1}).collect():
        t = dict(rows)[r.doc_id].split()
        z = [math.log(0.5) + sum(map(like[d], t)) * min(1, mixing.EVIDENCE / max(1, len(t))) for d in "ab"]
        want = [math.exp(x - max(z)) / sum(math.exp(y - max(z)) for y in z) for x in z]
        assert np.allclose(r.posterior, want, atol=1e-6)
    with_text = mixing.mix(df, labelled, {"a": 1, "b": 1}, keep_text=True)
    assert {r.doc_id: r.text for r in with_text.collect()} == dict(rows)


def test_mixing_defined_cases(spark):
    labelled = spark.createDataFrame([("alpha words", "a"), ("beta things", "b"), (None, "a"), ("x", None)], "text string, domain string")
    clashes = ["rate", "_id", "_hash", "_hash_of", "_tokens", "_p0", "_s0", "_e0", "_bucket", "c0", "c1"]
    got = mixing.mix(odd(spark).withColumns({c: F.lit("clash") for c in clashes}), labelled, {"a": 1, "b": 1})
    assert {tuple(r[c] for c in clashes[1:]) for r in got.collect()} == {("clash",) * 10}
    assert got.count() == 9 and all(r.n_tokens == 0 for r in got.collect() if r.doc_id in (2, 3, 5))
    assert mixing.mix(empty(spark), labelled, {"a": 1, "b": 1}).count() == 0
    assert {r.rate for r in mixing.mix(odd(spark), labelled.filter("domain = 'none'"), {}).collect()} == {1.0}
    with pytest.raises(ValueError, match="no target"):
        mixing.mix(odd(spark), labelled, {"a": 1})


# 4: URL rules


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/x?q#f", "x://www.example.com/en/", "x://www.example.com/EN/", "x://example.com", "x://b.net/es/1", "x://net/es/", "x://a.b.net/en?/es/", "x://ads.example.org/a", "x://loads.example.org/a", "x://evilexample.com/en/", "a://b://c.com/", "x://h.net:80/fr/", "x://h.net/fr/\nline", "x://www.Cheap-ads.org/", "x://a-b.org", "x://cheap.shop.org/x", "x://shop.org/cheap-ads.x", "x://shop.org/a/Ads/b", "x://shop.org/cheap", "x://shop.org/x/cheap\n", "x://my-blog.org/", "x://blog.museum.org/", "x://shop.ads/x", "x://net/fr/ads/"]
    df = spark.createDataFrame([(i, u, "clash", "own") for i, u in enumerate(urls)] + [(3, "http://", None, "own")], "page_id long, url string, host string, _best string")
    given = url_rules.host_rules(spark.createDataFrame(queries.HOST_RULES, "action string, host string, path string"))
    rules = given.unionByName(given).unionByName(url_rules.keyword_rules(spark.createDataFrame([("block", "cheap"), ("block", "ads")], "action string, word string")))

    def brute(u):
        if u is None or "://" not in u:
            host = path = ""
        else:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, a) for a, h, p in queries.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, max(fits)[1], max(fits)[2]
        marks = [*re.split("[.-]", host)[:-1], *path.lower().split("/")]
        return host, path, None, "block" if {"cheap", "ads"} & set(marks) else "allow"

    got = url_rules.judge(df, rules).collect()
    assert len(got) == len(urls) + 1
    assert all((r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id]) and r._best == "own" for r in got)
    alone = [url_rules.judge(df.filter(F.col("page_id") == k), rules).first() for k in (17, 24, 25)]
    assert [r.verdict for r in alone] == [brute(urls[r.page_id])[3] for r in alone] == ["block", "allow", "allow"]
    assert url_rules.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(df, rules.limit(0)).collect()} == {"allow"}
    with pytest.raises(ValueError, match="literal token"):
        url_rules.judge(df, spark.createDataFrame([("block", ".*", [], None, 0)], url_rules.RULES))


def test_url_rules_in_conflict(spark):
    """Of one pattern or of several: the greatest rank, then block, then the larger pattern, in any order of the rules."""
    df = spark.createDataFrame([(1, "x://a.org/one/two")], "page_id long, url string")
    rules = [("allow", "a.org/one", ["one"], "p", 1), ("block", "a.org/one", ["one"], "q", 1), ("allow", "/two", ["two"], "r", 1)]
    better = [*rules, ("allow", "one/two", ["two"], "s", 2), ("allow", "a.org/one", ["org"], "z", 0)]
    verdict = lambda rows: tuple(url_rules.judge(df, spark.createDataFrame(rows, url_rules.RULES)).first())[-2:]
    assert verdict(rules) == verdict(rules[::-1]) == ("q", "block")
    assert verdict(better) == verdict(better[::-1]) == ("s", "allow")


def test_url_keyword_rules_equal_every_rule_on_every_url(spark):
    """A few hundred rules on random URLs: the index loses none."""
    rng = random.Random(12)
    parts = [a + b for a in ("ca", "po", "be", "sl", "ad", "xx") for b in ("si", "no", "ts", "ker", "ds", "x")]
    some = lambda sep, n: sep.join(rng.choice(parts) for _ in range(rng.randint(1, n)))
    urls = [f"http://{some(rng.choice('.-'), 3)}.{some('-', 2)}/{some(rng.choice('/-'), 4)}{rng.choice(['', '/', '?q=1'])}" for _ in range(400)]
    words = spark.createDataFrame([(rng.choice(["block", "allow"]), w) for w in parts] + [("block", f"{a}{b}") for a in parts for b in "mnopq"], "action string, word string")
    hosts = spark.createDataFrame([("allow", some(".", 2), f"/{some('/', 2)}") for _ in range(60)], "action string, host string, path string")
    rules = url_rules.keyword_rules(words).unionByName(url_rules.host_rules(hosts))
    every = rules.collect()
    got = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    for r in got:
        fits = [(x.rank, x.action == "block", x.pattern, x.action) for x in every if re.search(x.pattern.replace(r"\z", r"\Z"), r.host + r.path)]
        assert r.verdict == (max(fits)[3] if fits else "allow")
    assert len(got) == 400 and 20 < sum(r.verdict == "block" for r in got) < 380


# 5: Jaccard join


def brute_join(docs):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set()) for i, w in words.items()}
    near = defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                near[a].add(b)
    classes = {}
    for i in sorted(sets):
        if i not in classes:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in classes:
                    classes[x] = i
                    todo += near[x]
    return {i: (classes[i], len(near[i])) for i in sets}


def near_copies(rng, groups, most):
    docs = []
    for _ in range(groups):
        body = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, most)):
            copy = list(body)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 9999)}"
            docs.append((len(docs), " ".join(copy)))
    return docs


def test_join_brute_force(spark):
    docs = near_copies(random.Random(5), 25, 8) + [(900, None), (901, ""), (902, "...")]
    got = chosen_path.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_join(docs)


def test_join_large_nodes_in_slices(spark, monkeypatch):
    """The same classes where every node is large; each linked document has a link."""
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    monkeypatch.setattr(chosen_path, "SLICE", 16)
    monkeypatch.setattr(chosen_path, "REPRESENTATIVES", 3)
    docs = near_copies(random.Random(7), 6, 60)
    got = chosen_path.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute_join(docs)
    assert {r.doc_id: r.class_id for r in got} == {i: c for i, (c, _) in want.items()}
    assert all((r.n_links > 0) == (want[r.doc_id][1] > 0) and r.n_links <= want[r.doc_id][1] for r in got)


def test_join_counts_every_link_of_large_groups(spark, monkeypatch):
    """More sets than `LISTED` in a bucket, and classes of several slices: numbers of links are those of all pairs."""
    monkeypatch.setattr(chosen_path, "LISTED", 8)
    monkeypatch.setattr(chosen_path, "SMALL", 32)
    monkeypatch.setattr(chosen_path, "SLICE", 16)
    docs = near_copies(random.Random(11), 5, 90)
    got = chosen_path.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_join(docs)


def test_join_one_group_of_thousands(spark):
    """Rows compared grow with a near-copy group, not with its square; classes equal brute force."""
    rng = random.Random(11)
    body = [f"w{rng.randint(0, 900)}" for _ in range(120)]
    docs = []
    for i in range(3000):
        copy = list(body)
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
        docs.append((i, " ".join(copy)))
    shingles = [{hash(tuple(t.split()[k : k + 5])) for k in range(116)} for _, t in docs]
    names = {x: k for k, x in enumerate({x for s in shingles for x in s})}
    has = np.zeros((len(docs), len(names)), np.float32)
    for i, s in enumerate(shingles):
        has[i, [names[x] for x in s]] = 1
    common = has @ has.T
    size = has.sum(1)
    label = chosen_path._labels((common >= 0.8 * (size[:, None] + size - common) - 1e-6) & ~np.eye(len(docs), dtype=bool))
    got = {r.doc_id: r.class_id for r in chosen_path.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[i] != label[i] for i in got) <= 0.002 * len(docs)


def boilerplate(rng, n, share, copies=0):
    """Documents of 120 words, of which `share` are the same in all and the rest random, and some near copies of the first ones."""
    common = [f"c{i}" for i in range(int(120 * share))]
    docs = [(i, " ".join([*common, *(f"w{rng.randrange(10**7)}" for _ in range(120 - len(common)))])) for i in range(n)]
    for i in range(copies):
        copy = docs[i][1].split()
        copy[rng.randrange(len(common), 120)] = "edit"
        docs.append((n + i, " ".join(copy)))
    return docs


def compared_rows(monkeypatch):
    """A list that gets the rows that each call of `verify` compares."""
    rows, verify = [], chosen_path.verify
    places = lambda n, one: F.when(F.col(f"p.{one}").isNull(), F.col(f"p.{n}")).otherwise(1)

    def counted(content, threshold):
        rows.append(content.select(F.explode("places").alias("p")).agg(F.sum(places("slices", "slice") * places("others", "other"))).first()[0] or 0)
        return verify(content, threshold)

    monkeypatch.setattr(chosen_path, "verify", counted)
    return rows


@pytest.mark.parametrize("share", [0.4, 0.6, 0.75])
def test_join_compares_no_boilerplate(spark, monkeypatch, share):
    """Documents that share boilerplate and are not similar: compared rows grow no faster than the documents."""
    rows, each = compared_rows(monkeypatch), []
    for n in (2000, 8000):
        done = sum(rows)
        got = chosen_path.join(spark.createDataFrame(boilerplate(random.Random(n), n, share), "doc_id long, text string").repartition(4))
        assert got.filter("doc_id <> class_id or n_links > 0").count() == 0
        each.append((sum(rows) - done) / n)
    assert each[1] <= each[0] + 1 and each[0] < 20, each


def test_join_finds_copies_within_boilerplate(spark, monkeypatch):
    rows = compared_rows(monkeypatch)
    docs = boilerplate(random.Random(3), 3000, 0.6, 400)
    got = {r.doc_id: r.class_id for r in chosen_path.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[3000 + i] == i for i in range(400)) >= 0.99 * 400
    assert all(got[i] == i for i in range(3000)) and sum(rows) <= 10 * len(docs)


def test_join_finds_what_shares_only_boilerplate(spark, monkeypatch):
    """Documents that are boilerplate and a few words are similar, though every sampled token that they share is common in their nodes."""
    monkeypatch.setattr(chosen_path, "SMALL", 32)
    rng = random.Random(4)
    docs = boilerplate(rng, 1000, 0.7)
    docs += [(1000 + i, " ".join([*docs[0][1].split()[:84], *(f"x{rng.randrange(10**7)}" for _ in range(4))])) for i in range(30)]
    got = chosen_path.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (i, 0) if i < 1000 else (1000, 29) for i, _ in docs}


def test_join_in_split_nodes_equals_brute_force(spark, monkeypatch):
    """Split nodes with documents that are boilerplate and more or fewer other words, in lists of one slice and of several."""
    monkeypatch.setattr(chosen_path, "SMALL", 16)
    monkeypatch.setattr(chosen_path, "SLICE", 16)
    monkeypatch.setattr(chosen_path, "REPRESENTATIVES", 3)
    rng = random.Random(8)
    docs = boilerplate(rng, 450, 0.7)
    common = docs[0][1].split()[:84]
    for own, n in ((3, 25), (6, 25), (14, 12), (20, 12), (0, 1)):
        block = [f"b{own}-{i}" for i in range(rng.choice([0, 4, 12]))]
        docs += [(len(docs) + i, " ".join([*common, *block, *(f"x{rng.randrange(10**7)}" for _ in range(rng.randint(own // 2, own)))])) for i in range(n)]
    got = chosen_path.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_join(docs)


def test_join_takes_few_tasks_for_small_tables(spark, monkeypatch):
    """With many shuffle partitions each step on a small table, but those that compare texts, writes few files; same classes and links."""
    files, materialise = {}, chosen_path.materialise

    def counted(df, name):
        out = materialise(df, name)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(chosen_path, "materialise", counted)
    monkeypatch.setattr(components, "materialise", counted)
    monkeypatch.setattr(chosen_path, "SMALL", 16)
    rng = random.Random(9)
    docs = boilerplate(rng, 150, 0.7, 30)
    common = docs[0][1].split()[:84]
    docs += [(180 + i, " ".join([*common, *(f"x{rng.randrange(10**7)}" for _ in range(rng.randint(1, 4)))])) for i in range(30)]
    hot = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in hot}
    try:
        for k, v in hot.items():
            spark.conf.set(k, v)
        got = chosen_path.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_join(docs)
    assert {"path-sets", "path-children", "path-left", "path-prefixes", "roots", "path-classes"} <= set(files)
    # Two tasks for each of four cores; a task that has rows writes one file.
    assert {name: n for name, n in files.items() if name != "path-links" and max(n) > 8} == {}


def test_few_tasks_grow_with_the_rows(spark):
    rows = spark.range(1000).repartition(50, "id").withColumn("was", F.spark_partition_id()).withColumn("_", F.rand())
    tasks = lambda n: tables.few_tasks(rows, n).rdd.getNumPartitions()
    assert [tasks(n) for n in (0, 1000, 8 * tables.TASK_ROWS, 20 * tables.TASK_ROWS, 10**9)] == [8, 8, 8, 20, 50]
    now = tables.few_tasks(rows, 1000).withColumn("now", F.spark_partition_id())
    assert now.count() == 1000 and now.groupBy("was").agg(F.count_distinct("now").alias("n")).filter("n > 1").isEmpty()


def test_components_of_repeated_edges(spark):
    edges = [(2, 1), (1, 2), (2, 1), (3, 2), (3, 2), (7, 7), (9, 8), (9, 8), (12, 9), (11, 12), (11, 12)]
    got = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted((r.node, r.root) for r in got.collect()) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (11, 8), (12, 8)]
    assert got._scratch  # a table that `discard` deletes


def test_join_keeps_texts_of_one_id(spark):
    docs = [(1, "one two three four five six"), (1, "other words are in this row"), (2, "one two three four five six"), (2, "one two three four five six"), (3, None), (3, None), (None, "x"), (None, "x")]
    kept = chosen_path.keep_first(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, "x"), (-1, "x"), (1, "one two three four five six"), (1, "other words are in this row"), (3, "")]


def test_later_ids_read_every_text_of_an_id(spark):
    whole = [(1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, "all of these words differ here")]
    cut = [(1, "one two three four five six seven"), (2, "seven"), (4, "seven"), (5, ""), (6, "")]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc for r in chosen_path.later_ids([df(cut), df(whole)], df(cut).select("doc_id")).collect()) == [2, 4]


def test_likely_loses_none(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BITS", 17)
    rows = spark.range(20_000).withColumnRenamed("id", "x")
    wanted = rows.filter("x % 100 = 3").withColumnRenamed("x", "y")
    got = {r.x for r in chosen_path.likely(rows, "x", wanted).collect()}
    assert {x for x in range(20_000) if x % 100 == 3} <= got and len(got) < 400
    assert chosen_path.likely(rows, "x", wanted.limit(0)).count() == 0


def test_join_defined_cases(spark):
    got = chosen_path.join(odd(spark)).collect()
    assert sorted((r.doc_id or -1, r.class_id, r.n_links) for r in got if r.doc_id in (1, 2, 3, None)) == [(-1, None, 0), (1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 3, 0)]
    assert chosen_path.join(empty(spark)).count() == 0
    kept = chosen_path.keep_first(odd(spark))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7] and kept.columns == odd(spark).columns


def test_runs_needed_reach_the_recall():
    for levels in (1, 2, 3, 4):
        n = chosen_path.runs_needed(levels)
        assert (1 - 0.8**levels) ** n <= 1 - chosen_path.RECALL < (1 - 0.8**levels) ** (n - 1)


def test_sampled_tokens_keep_pairs_at_the_threshold():
    width = chosen_path.runs_needed(chosen_path.LEVELS) * chosen_path.LEVELS
    cut = chosen_path.least_matches(width, 0.8)
    below = sum(math.comb(width, m) * 0.8**m * 0.2 ** (width - m) for m in range(cut))
    assert below < 1e-4 and cut > width // 2


def test_trees_reach_the_recall_in_large_nodes(spark):
    """Pairs of similarity 0.8 in four levels of nodes far above SMALL; every token has one of eight values."""
    rng, pairs = np.random.default_rng(6), 6000
    runs = chosen_path.runs_needed(chosen_path.LEVELS)
    a = rng.integers(0, 8, (pairs, runs * chosen_path.LEVELS), dtype=np.uint16)
    b = np.where(rng.random(a.shape) < 0.8, a, (a + rng.integers(1, 8, a.shape)) % 8).astype(np.uint16)
    rows = [(2 * i + side, 1, x[:runs].tolist(), x.tobytes()) for side, both in enumerate((a, b)) for i, x in enumerate(both)]
    sets = spark.createDataFrame(rows, "set long, size long, sig array<long>, sketch binary").repartition(4).cache()
    leaves, large = chosen_path.grow(sets, 0.8, [])
    both = leaves if large is None else leaves.unionByName(large)
    met = both.groupBy("key", F.floor(F.col("set") / 2).alias("pair")).count().filter("count = 2").select("pair").distinct().count()
    assert pairs - met <= 0.002 * pairs


@pytest.mark.parametrize("n", [1000, 4000])
def test_split_nodes_place_sets_by_their_rarest_tokens(spark, n):
    """Half of the tokens of one large node are of its boilerplate: few sets go to a leaf, and all pairs with the least equal tokens meet in one."""
    rng, pairs = np.random.default_rng(n), 200
    runs = chosen_path.runs_needed(chosen_path.LEVELS)
    width = runs * chosen_path.LEVELS
    cut = chosen_path.least_matches(width, 0.8)
    token = lambda size: np.where(rng.random(size) < 0.5, rng.integers(0, 12, size), rng.integers(12, 2**16, size)).astype(np.uint16)
    a = token((n, width))
    b = token((pairs, width))
    for i in range(pairs):
        same = rng.permutation(width)[:cut]
        b[i, same] = a[i, same]
    rows = [(i, 1, [7, *rng.integers(0, 2**60, runs - 1).tolist()], x.tobytes()) for i, x in enumerate(np.concatenate((a, b)))]
    sets = spark.createDataFrame(rows, "set long, size long, sig array<long>, sketch binary").repartition(4).cache()
    leaves, large = chosen_path.grow(sets, 0.8, [])
    assert large is None or large.isEmpty()
    met = leaves.withColumn("pair", F.when(F.col("set") < n, F.col("set")).otherwise(F.col("set") - n)).groupBy("key", "pair").count().filter("count = 2").select("pair").distinct().count()
    assert met == pairs
    assert leaves.count() <= 4 * n


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 6: top-k


def test_ball_tree_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "SHARD", 20)
    monkeypatch.setattr(ball_tree, "CELLS", 6)
    monkeypatch.setattr(ball_tree, "QUERIES", 4)
    monkeypatch.setattr(ball_tree, "LEAF", 5)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(300)]
    rows += [(1000, None), (1020, [1.0] * 5 + [None]), (1040, [math.nan] * 6), (1060, [math.inf] + [0.0] * 5), (None, [1.0] * 6), (1080, []), (1100, list(rows[3][1]))]
    got = defaultdict(list)
    for r in sorted(ball_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    fine = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in fine if i % 20 == 0]:
        want = sorted(((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q))[:20]
        assert got[q] == [(i, -s) for s, i in want]
    assert set(got) == {i for i in fine if i % 20 == 0}
    again = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [1.0, 1.0]), (21, [1.0, 1.0]), (22, [1e300, 1.0])], "vec_id long, embedding array<double>")
    told = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ball_tree.top_k(again, F.col("vec_id") == 20).collect())
    assert told == sorted([(20, 1, 22, 2**62), (20, 2, 21, 4096), (20, 3, 21, 4096), (20, 1, 21, 4096), (20, 2, 21, 4096), (20, 3, 22, 4096)])
    one = spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")
    assert ball_tree.top_k(one, F.col("vec_id") == 0).count() == 0 and ball_tree.top_k(one.limit(0), F.col("vec_id") == 0).count() == 0


# 8: LM scoring


def test_gru_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.new(np.array([9, 7, 5, 3]), np.array([16.0, 8.0, 5.0]), 2, 2, 3).items()}
    x, c, s = np.array([[0, 1], [7, 4], [5, 2]]), np.array([[0, 1], [2, 0], [1, 2]]), np.array([[1, 0], [0, 0], [1, 0]])
    x = np.minimum(x, len(p["x"]) - 1)
    h0 = rng.normal(size=(3, 2))
    g, _, loss = gru.gradients(p, x, c, s, h0)
    assert np.isclose(loss, -gru.log_probs(p, gru.by_token(gru.states(p, x, h0)[0]), c.ravel(), s.ravel()).mean(), atol=1e-4)

    def numeric(name, at, eps=1e-2):
        old, out = p[name][at], []
        for sign in (1, -1):
            p[name][at] = old + sign * eps
            out.append(-gru.log_probs(p, gru.by_token(gru.states(p, x, h0)[0].astype(np.float64)), c.ravel(), s.ravel()).mean())
        p[name][at] = old
        return (out[0] - out[1]) / (2 * eps)

    for at in ((0, 0), (1, 4), (2, 8)):
        assert np.isclose(g["u"][at], numeric("u", at), atol=2e-3)
    for at in ((0, 1), (2, 2)):
        assert np.isclose(g["c"][at], numeric("c", at), atol=2e-3)
    rows, dx = g["x"]
    for i, r in enumerate(rows):
        assert np.isclose(dx[i, 1], numeric("x", (r, 1)), atol=2e-3)
    for k in g["w"]:
        assert np.isclose(g["w"][k][1, 0], numeric("w", (k, 1, 0)), atol=2e-3)


def test_gru_places_that_fill_up_count_for_nothing():
    rng = np.random.default_rng(3)
    p = gru.new(np.array([9, 7, 5, 3]), np.array([16.0, 8.0, 5.0]), 2, 2, 3)
    x, c, s = rng.integers(0, 6, (6, 2)), rng.integers(0, 3, (6, 2)), rng.integers(0, 2, (6, 2))
    whole, _, loss = gru.gradients(p, x[:4], c[:4], s[:4], np.zeros((3, 2), np.float32))
    part, _, same = gru.gradients(p, x, c, s, np.zeros((3, 2), np.float32), np.arange(6)[:, None] + np.zeros((1, 2)) < 4)
    assert np.isclose(loss, same) and all(np.allclose(whole[k], part[k], atol=1e-6) for k in ("c", "cb", "u"))
    assert all(np.allclose(whole["w"][k], part["w"][k], atol=1e-6) for k in part["w"]) and set(whole["w"]) == set(part["w"])


def test_byte_words_are_those_of_code_points():
    import pyarrow as pa

    texts = ["", "Ab c", None, "x", " é\tü ñandú\n", "ab", "C c", "日本 ab"]
    tokens = lm_scoring.Tokenizer()
    for lo in (0, 3):
        h, _, sizes = tokens(pa.array(texts).slice(lo))
        words = [w for t in texts[lo:] for w in [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]]
        assert sizes.tolist() == [len((t or "").split()) + 1 for t in texts[lo:]]
        assert all((a == b) == (x == y) for a, x in zip(words, h) for b, y in zip(words, h))


def test_gru_softmax_sums_to_one():
    p = gru.new(np.array([9, 7, 5, 3]), np.array([16.0, 8.0, 5.0]), 2, 2, 3)
    h = np.random.default_rng(1).normal(size=(1, 3)).astype(np.float32)
    pairs = [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    got = gru.log_probs(p, np.repeat(h, 5, 0), np.array([c for c, _ in pairs]), np.array([s for _, s in pairs]))
    assert np.isclose(np.exp(got).sum(), 1, atol=1e-5)


def test_lm_state_is_carried_across_windows():
    """A document's score is the same alone, one step at a time, and among others."""
    rng = np.random.default_rng(6)
    p = gru.new(np.arange(lm_scoring.HEADS * lm_scoring.WIDTH, 0, -1), np.ones(lm_scoring.HEADS + lm_scoring.TAILS) * 9, lm_scoring.HEADS, lm_scoring.WIDTH, lm_scoring.HIDDEN)
    sizes = np.array([5, 700, 1, 40])
    ids = rng.integers(0, lm_scoring.START, sizes.sum()).astype(np.int32)
    own = ids < lm_scoring.HEADS * lm_scoring.WIDTH
    c, s = np.where(own, ids // lm_scoring.WIDTH, lm_scoring.HEADS + ids % lm_scoring.TAILS), np.where(own, ids % lm_scoring.WIDTH, 0)
    got = lm_scoring._score_batch(p, ids, c, s, sizes)
    x = lm_scoring._previous(ids, sizes)
    at = 0
    for total, n in zip(got, sizes):
        h, want = np.zeros((lm_scoring.HIDDEN, 1), np.float32), 0.0
        for t in range(at, at + n):
            h = gru.states(p, x[t : t + 1, None], h)[0][0]
            want += gru.log_probs(p, np.ascontiguousarray(h.T), c[t : t + 1], s[t : t + 1])[0]
        assert np.isclose(total, want, rtol=1e-4)
        at += n


def test_lm_scores(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op8_lm_score(spark, d).collect()}
    docs = {r.doc_id: r.text for r in load(spark, d, "documents").collect()}
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in docs.items()}
    counts = Counter(w for i, ws in tokens.items() if not held(i, 7, 2) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i, 7, 2), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > 0.95 * sum(r.base_score for r in out)


def test_lm_defined_cases(spark):
    clashes = ["_row", "_far", "_text", "_near", "_base", "_known", "_log", "_f", "c0"]
    got = lm_scoring.score(odd(spark).withColumns({c: F.lit("clash") for c in clashes}), F.lit(True)).collect()
    assert {tuple(r[c] for c in clashes) for r in got} == {("clash",) * 9}
    assert len(got) == 9 and all(r.n_tokens == 1 for r in got if r.doc_id in (2, 3, 5)) and all(math.isfinite(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    none = lm_scoring.score(odd(spark), F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in none)
    assert lm_scoring.score(empty(spark), F.lit(True)).count() == 0


# 9: language


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op9_language(spark, d).collect()}
    right = [got[r.doc_id].lang_pred == r.lang for r in load(spark, d, "documents").collect() if got[r.doc_id].held_out]
    assert np.mean(right) > 0.98 and all(r.held_out == held(k, 3, 1) and 0 <= r.score <= 1 for k, r in got.items())


def test_language_defined_cases(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "de"), ("x", None)], "text string, lang string")
    model = language.fit(train, "text", "lang")
    got = language.predict(odd(spark), model)
    assert got.count() == 9
    assert {r.lang_pred for r in got.collect() if r.doc_id in (2, 3, 5, 6)} == {"und"}
    assert set(model["langs"]) == {"en", "fr"}
    assert language.predict(empty(spark), model).count() == 0
    far = language.predict(spark.createDataFrame([(1, "яблоко груша")], "doc_id long, text string"), model).first()
    assert far.rejected and far.lang_pred in ("en", "fr")
    nothing = language.fit(train.filter("lang = 'de'"), "text", "lang")
    assert {r.lang_pred for r in language.predict(odd(spark), nothing).collect()} == {"und"}


# 10: decontamination


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert latent_decontam.common(np.array(a, int), np.array(b, int)) == table[-1][-1]


def test_decontamination_finds_verbatim_and_paraphrase(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 50))) + ". " + " ".join(word() for _ in range(6)) + ".") for i in range(12)]
    prose = lambda n: " ".join(word() for _ in range(n))
    changed = lambda t: " ".join(word() if k % 4 == 3 and k < len(t.split()) - 7 else w for k, w in enumerate(t.split()))
    docs = [(i, f"{prose(rng.randint(0, 80))} {t} {prose(60)}") for i, t in items] + [(100 + i, f"{prose(50)} {changed(t)} {prose(20)}") for i, t in items] + [(200 + k, prose(200)) for k in range(30)]
    got = {r.doc_id: r["items"] for r in latent_decontam.flag(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(got[i] == [i] and got[100 + i] == [i] for i, _ in items)
    assert not any(got[200 + k] for k in range(30))


def brute_decontamination(texts, items):
    """The check at every window, without any retrieval: {text index: item ids}."""
    table, powers = textarrays.alnum_table(), textarrays.Powers()
    hashed = lambda t: latent_decontam._words([t], table, powers)[0]
    held = defaultdict(list)
    for k, text in items:
        item, answer = hashed(text), hashed(re.split(r"(?<=[.!?])\s+", text)[-1])
        for i, t in enumerate(texts):
            h = hashed(t)
            spans = [h[max(0, s - len(item)) : s + 32 + len(item)] for s in range(0, max(1, len(h) - 16), 16)]
            kept = [(latent_decontam.common(item, x) / len(item), latent_decontam.common(answer, x) / len(answer)) for x in spans]
            if any(x >= 0.8 or x >= 0.6 and y >= 0.8 for x, y in kept):
                held[i].append(k)
    return {i: sorted(x) for i, x in held.items()}


def test_decontamination_equals_the_check_at_every_window(spark):
    rng = random.Random(18)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(900)]
    prose = lambda n: [vocabulary[int(900 * rng.random() ** 3)] for _ in range(n)]
    items = [(i, " ".join(prose(rng.randint(9, 53))) + ". " + " ".join(prose(6)) + ".") for i in range(40)]
    texts = []
    for _, text in items:
        for share in (0.2, 0.3, 0.35, 0.4):
            w = text.split()
            for k in rng.sample(range(len(w) - 6), min(len(w) - 6, round(share * len(w)))):
                w[k] = prose(1)[0]
            texts.append(" ".join(prose(rng.randint(0, 120)) + w + prose(rng.randint(0, 120))))
    want = brute_decontamination(texts, items)
    got = latent_decontam.flag(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 0.8 * len(texts) and {r.doc_id: r["items"] for r in got if r["items"]} == want


def test_decontamination_finds_verbatim_items_of_any_length(spark):
    rng = random.Random(28)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    prose = lambda n: " ".join(vocabulary[int(3000 * rng.random() ** 2)] for _ in range(n))
    items = [(10 * n + k, prose(n)) for n in (5, 8, 12, 100, 150, 300) for k in range(6)]
    docs = [(i, f"{prose(rng.randint(300, 340))} {t} {prose(300)}") for i, t in items]
    got = {r.doc_id: r["items"] for r in latent_decontam.flag(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(i in got[i] for i, _ in items)


def test_decontamination_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(latent_decontam, "ITEMS", 3)
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    items = [(i, prose(25)) for i in range(8)]
    docs = [(i, f"{prose(20)} {t} {prose(9)} {items[(i + 1) % 8][1]}") for i, t in items]
    got = {r.doc_id: r["items"] for r in latent_decontam.flag(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: sorted((i, (i + 1) % 8)) for i, _ in items}


def test_decontamination_defined_cases(spark):
    items = spark.createDataFrame([(1, None), (2, "few words"), (None, "a b c d e f g"), (3, "a plain text of words here")], "item_id long, text string")
    got = latent_decontam.flag(odd(spark).withColumn("items", F.lit("clash")), items).collect()
    assert len(got) == 9 and all(r["items"] == ([3] if r.doc_id == 1 else []) for r in got)
    assert latent_decontam.flag(empty(spark), items).count() == 0
    assert all(r["items"] == [] for r in latent_decontam.flag(odd(spark), items.limit(0)).collect())


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    docs = load(spark, d, "documents")
    columns = docs.columns
    labels = load(spark, d, "labels").collect()
    toxic, clean = ({r.doc_id for r in labels if r.toxic == t and r.quality == 1} for t in (1, 0))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "toxicity":
            left = {r.doc_id for r in docs.select("doc_id").collect()}
            assert len(left & toxic) <= 0.15 * len(toxic) and len(left & clean) >= 0.97 * len(clean)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    assert not any(r["items"] for r in latent_decontam.flag(docs, load(spark, d, "benchmark")).collect())
    assert all(r.n_links == 0 for r in chosen_path.join(docs).collect())
    final = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert final.count() == sizes[-1] and {*columns, "rate", "copies", "domain"} <= set(final.columns)
    assert {r.doc_id: r.text for r in final.collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_pipeline_leaves_no_remnant_of_a_near_copy(spark, tmp_path):
    """A copy with one edited line in ten loses nine to line dedup; what is left of it goes, too."""
    import corpus_pipeline

    rng = random.Random(8)
    lines = [" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 10**6)}x" for _ in range(12)) for _ in range(30)]
    edited = lines[:7] + [" ".join(f"q{k}z{k}" for k in range(12))] + lines[8:]
    other = [" ".join(f"o{rng.choice('abcdefgh')}{rng.randint(0, 10**6)}x" for _ in range(12)) for _ in range(5)]
    rows = [(1, "\n".join(lines), "en", "s", 1), (2, "\n".join(edited), "en", "s", 1), (3, "\n".join(other), "en", "s", 1), (3, "\n".join(other), "en", "s", 1), (None, "no id", "en", "s", 5), (4, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = corpus_pipeline.drop_lines(spark, load(spark, str(tmp_path), "documents"), str(tmp_path))
    assert {r.doc_id: r.text for r in docs.collect()}[2] == edited[7]
    left = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 3, 4] and left.columns == docs.columns


@pytest.mark.parametrize("number", range(5))
def test_pipeline_stages_defined_cases(spark, sf, number):
    """Nulls in any column, empty and long texts, repeated rows, an extra column of a clashing name."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[number]
    clashes = ["score", "doc", "items", "overlap", "n_lines", "n_dropped", "_toxic", "_toxicity", "_later", "_text_hash", "_found", "_items", "_id", "_p0", "_lines"]
    docs = odd(spark).select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit("clash").alias(c) for c in clashes])
    got = stage(spark, docs, sf)
    assert {tuple(r) for r in got.select(clashes).collect()} == {("clash",) * len(clashes)}
    ids = sorted(r.doc_id or -1 for r in got.collect())
    assert set(ids) >= ({-1, 2, 6} if name == "line_dedup" else {-1, 1, 2, 3, 4, 5, 6, 7}) and len(ids) <= 9
    assert got.columns[: len(docs.columns)] == docs.columns


def test_pipeline_takes_empty_documents(spark, sf):
    import corpus_pipeline

    docs = load(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_pipeline_equals_brute_force(spark, sf):
    """All five stages over whole texts, each done plainly on what the one before it kept.

    Learned weights are the library's; what they decide is computed here.
    """
    import corpus_pipeline

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    table = load(spark, sf, "documents")
    original = {r.doc_id: r.text for r in table.collect()}
    model = toxicity.fit(labelled_rows(table, load(spark, sf, "labels"), F.col("toxic").cast("int"), queries.TRAIN_ROWS), "text", "label")
    weight = dict(zip(model["chosen"].tolist(), model["weights"].tolist()))
    toxic = set()
    for i, t in original.items():
        t = (t or "").lower()
        grams = {t[k : k + n] for n in model["orders"] for k in range(len(t) - n + 1)}
        z = model["bias"] + sum(weight.get(b, 0) for b in {plain_bucket(g, model["bits"]) for g in grams})
        if 1 / (1 + math.exp(-z)) >= 0.3:
            toxic.add(i)
    con = connect(sf)
    con.sql("CREATE TABLE left_over AS SELECT * FROM documents WHERE doc_id NOT IN (SELECT unnest([" + ",".join(map(str, [-1, *sorted(toxic)])) + "]))")
    con.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM left_over")
    cut = {i: t for i, t, n in con.sql(f"SELECT doc_id, text, n_dropped FROM ({queries.OP2_SQL})").fetchall() if n == 0 or (t or "").strip()}
    near = [brute_join(list(cut.items())), brute_join([(i, original[i]) for i in cut])]
    root = {i: i for i in cut}
    changed = True
    while changed:
        changed = False
        for classes in near:
            least = defaultdict(lambda: 1 << 60)
            for i in cut:
                least[classes[i][0]] = min(least[classes[i][0]], root[i])
            for i in cut:
                if least[classes[i][0]] < root[i]:
                    root[i], changed = least[classes[i][0]], True
    once = [i for i in cut if root[i] == i]
    items = [(r.item_id, r.text) for r in load(spark, sf, "benchmark").collect()]
    held = brute_decontamination([cut[i] or "" for i in once], items)
    clean = {i: cut[i] for k, i in enumerate(once) if k not in held}
    assert len(toxic) > 5 and len(cut) > len(once) > len(clean) > 50
    assert {i: r.text for i, r in got.items()} == clean
    rows = [got[i] for i in clean]
    tokens, p = np.array([len((r.text or "").split()) for r in rows], float), np.array([r.posterior for r in rows])
    lang = {r.doc_id: r.lang for r in table.collect()}
    domains = sorted({f"{lang[r.doc_id]}/{r.quality}" for r in load(spark, sf, "labels").collect() if r.doc_id in clean and lang[r.doc_id] and r.quality is not None})
    want, _ = brute_rates(tokens, p, np.array([queries.MIX_TARGETS[d] for d in domains]) / sum(queries.MIX_TARGETS[d] for d in domains))
    assert [r.domain for r in rows] == [domains[k] for k in p.argmax(1)]
    assert [r.n_tokens for r in rows] == tokens.tolist() and np.allclose([r.rate for r in rows], want, atol=1e-4)
