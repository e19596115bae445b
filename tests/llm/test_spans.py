"""Word runs, shared spans and ranked search: brute force on small tables, and the defined cases."""

import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from recordforge.llm import impact_search, shared_spans, textarrays, word_runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, score string"
LONG = "word " * 30_000


def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, a clashing column."""
    same = "a text of more than thirteen words which stands in two rows of one and the same id here"
    return spark.createDataFrame([(1, same, "en", "x"), (1, same, "en", "x"), (2, None, "en", None), (3, "", None, "y"), (None, same, "en", "z"), (4, LONG, None, None), (5, "  \n\t ", "fr", "q"), (7, "x\0y \0 é", "de", "q"), (8, f"before  it {same}\nafter", "de", "q")], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text("ab é\n\x1c", max_size=12), min_size=1, max_size=5), st.randoms(use_true_random=False))
def test_kept_words_are_joined_by_one_space(texts, rand):
    words = [WORD.findall(t or "") for t in texts]
    keep = [[rand.random() < 0.6 for _ in w] for w in words]
    _, begin, end, first, raw = textarrays.byte_words(pa.array(texts, pa.string()), *textarrays.byte_lane(), textarrays.Powers())
    got = textarrays.kept_text(raw, begin, end, first, np.array([k for ks in keep for k in ks], bool))
    assert got.to_pylist() == [" ".join(x for x, k in zip(w, ks) if k) for w, ks in zip(words, keep)]


# 11: runs


def plain_runs(x):
    """(start, period, length) of all runs, lag after lag."""
    found = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(q % r == 0 and all(x[t] == x[t + r] for t in range(i, i + n - r)) for r in range(1, q)):
                found.append((i, q, n))
            i = max(i + 1, j)
    return sorted(found)


def planted(rand, most):
    x = [rand.randrange(rand.choice([1, 2, 3, 50])) for _ in range(rand.randint(0, most))]
    for _ in range(rand.randint(0, 4)):
        if len(x) < 5:
            break
        a = rand.randrange(len(x))
        p, n = rand.randint(1, max(1, (len(x) - a) // 4)), rand.randint(0, len(x) - a)
        for i in range(a, a + n):
            x[i] = x[a + (i - a) % p]
        if rand.random() < 0.3:
            x[rand.randrange(len(x))] = 99
    return x


@settings(max_examples=300, deadline=None)
@given(st.randoms(use_true_random=False))
def test_runs_equal_brute_force(rand):
    x = planted(rand, 400)
    start, length, period = word_runs.find_runs(np.array(x, np.int64), len(x))
    assert list(zip(start.tolist(), period.tolist(), length.tolist())) == plain_runs(x)


def test_runs_of_a_batch_are_those_of_each_text(spark):
    rand = random.Random(3)
    texts = [" ".join(f"w{w}" for w in planted(rand, 300)) for _ in range(60)]
    got = word_runs.collapse_runs(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()
    for r in got:
        x = texts[r.id].split()
        runs = plain_runs(x)
        assert [(s.start, s.period, s.length) for s in r.runs] == runs and r.n_words == len(x)
        assert r.collapsed == " ".join(w for i, w in enumerate(x) if not any(a + q <= i < a + n for a, q, n in runs))


def test_runs_of_very_long_periods_and_texts():
    rand = np.random.default_rng(5)
    part = rand.integers(0, 1 << 40, 50_000)
    ids = np.concatenate((rand.integers(0, 1 << 40, 777), np.tile(part, 5)[:-3], [1, 2, 3]))
    assert [x.tolist() for x in word_runs.find_runs(np.unique(ids, return_inverse=True)[1], len(ids))] == [[777], [249_997], [50_000]]
    assert [x.tolist() for x in word_runs.find_runs(np.zeros(300_000, np.int64), 300_000)] == [[0], [300_000], [1]]


def test_runs_defined_cases(spark):
    got = word_runs.collapse_runs(odd(spark).withColumn("runs", F.lit("clash")).withColumn("n_words", F.lit(None)))
    assert got.columns[:4] == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and got.count() == 9
    by = {r.doc_id: r for r in got.collect()}
    assert by[2].collapsed is None and by[2].runs == [] and by[2].n_words == 0 and by[3].collapsed == "" and by[5].collapsed == ""
    assert [tuple(r) for r in by[4].runs] == [(0, 30_000, 1)] and by[4].collapsed == "word" and by[7].collapsed == "x\0y \0 é" and by[1].score == "x"
    assert word_runs.collapse_runs(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        word_runs.find_runs(np.zeros(9, np.int64), 9, times=3)


# 12: spans


def plain_spans(rows, window):
    """Whether each word of each row is covered by a window that a smaller id holds."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        yield w, gone


@pytest.mark.parametrize("vocabulary, window, unit", [(2, 13, 4), (4, 5, 2), (30, 13, 4), (1000, 13, 4), (3, 4, 4), (3, 3, 1)])
def test_spans_equal_brute_force(spark, vocabulary, window, unit):
    rand = random.Random(vocabulary)
    passages = [[f"w{rand.randrange(vocabulary)}" for _ in range(rand.randint(3, 60))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rand.randint(0, 4)):
            p = list(rand.choice(passages))
            if rand.random() < 0.4:
                p[rand.randrange(len(p))] = f"w{rand.randrange(vocabulary)}"
            w += p[rand.randint(0, 3) :] + [f"w{rand.randrange(vocabulary)}" for _ in range(rand.randint(0, 9))]
        rows.append((rand.randrange(120), "  ".join(w)))
    rows += [(None, rows[0][1]), (7, None)]
    table = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int").repartition(5)
    got = {r.k: r for r in shared_spans.drop_repeats(table, window=window, unit=unit).collect()}
    assert len(got) == len(rows)
    for k, (w, gone) in enumerate(plain_spans(rows, window)):
        r = got[k]
        assert (r.n_words, r.n_removed) == (len(w), sum(gone))
        assert r.text == (None if rows[k][1] is None else " ".join(x for x, g in zip(w, gone) if not g))
        covered = [i for s in r.repeats for i in range(s.start, s.start + s.length)]
        assert covered == [i for i, g in enumerate(gone) if g] and all(b.start > a.start + a.length for a, b in zip(r.repeats, r.repeats[1:]))


def test_spans_hot_passage(spark):
    """A passage in every document, each time in other surroundings."""
    common = " ".join(f"c{i}" for i in range(40))
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), "id", F.lit(f" {common} y"), F.col("id") % 7).alias("text"))
    got = shared_spans.drop_repeats(table)
    assert got.groupBy("n_removed").count().orderBy("n_removed").collect() == [(0, 1), (40, 6), (41, 2993)]


def test_spans_defined_cases(spark):
    got = shared_spans.drop_repeats(odd(spark).withColumn("_own", F.lit("a")).withColumn("_masks", F.lit("b")).withColumn("repeats", F.lit("c")))
    assert got.columns == ["doc_id", "text", "lang", "score", "_own", "_masks", "n_words", "n_removed", "repeats"] and got.count() == 9
    rows = got.collect()
    by = {r.doc_id: r for r in rows}
    assert all(r.n_removed == 0 for r in rows if r.doc_id != 8) and by[2].text is None and by[3].text == "" and by[4].n_words == 30_000
    assert by[8].text == "before it after" and [tuple(s) for s in by[8].repeats] == [(2, 19)] and by[8]["_own"] == "a"
    assert shared_spans.drop_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        shared_spans.Stretches(3, 4)


# 13: search


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, top):
    terms = [(i, Counter(plain_terms(t))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n_docs, n_terms = len(terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    for item, text in items:
        scores = []
        for i, c in terms:
            m = 25 + 75 * c.total() * n_docs // n_terms
            s = sum(int(np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1)))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text))
            scores += [(-s, i)] if s > 0 else []
        yield from ((item, k, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top], 1))


@pytest.mark.parametrize("vocabulary, depth, shard", [(6, 1, 200), (40, 2, 1 << 20), (400, 64, 3000)])
def test_search_equals_brute_force(spark, monkeypatch, vocabulary, depth, shard):
    for name, value in (("DEPTH", depth), ("SHARD", shard), ("TERMS", 30)):
        monkeypatch.setattr(impact_search, name, value)
    rand = random.Random(vocabulary)
    text = lambda n: " ".join(rand.choice(["T{}", "t{}", "é{}.", "x-{}"]).format(int(rand.paretovariate(0.5)) % vocabulary) for _ in range(rand.randint(0, n)))
    docs = [(k * 7 % 601, text(40)) for k in range(300)]
    docs += [(1000 + k, docs[3][1]) for k in range(15)]
    items = [(k, text(25)) for k in range(12)] + [(50, docs[3][1])]
    got = impact_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id int, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_search(docs, items, 10))


def test_search_stops_before_the_lists_end():
    """With a high floor only the front of the lists is followed to the end."""
    n = 4000
    shard = impact_search.Shard(np.tile(np.arange(n), 2), np.repeat([0, 1], n), np.concatenate((np.arange(n), np.arange(n)[::-1] % 7)), n, 2)
    best, score = shard.search(np.array([0, 1]), np.array([1, 2]), 1, 3)
    order = np.lexsort((best, -score))[:3]
    want = np.arange(n) + 2 * (np.arange(n)[::-1] % 7)
    assert best[order].tolist() == np.lexsort((np.arange(n), -want))[:3].tolist() and score[order].tolist() == sorted(want.tolist())[:-4:-1]
    assert len(best) < 40


def test_search_defined_cases(spark):
    items = spark.createDataFrame([(1, "words which stand"), (2, None), (None, "words"), (3, "... !"), (4, "nowhere"), (1, "zzz"), (5, LONG)], "item_id long, text string")
    got = impact_search.search(odd(spark).withColumn("rank", F.lit("clash")), items).collect()
    assert {r.item_id for r in got} == {1, 5} and [(r.rank, r.doc_id) for r in got if r.item_id == 5] == [(1, 4)]
    assert sorted((r.rank, r.doc_id) for r in got if r.item_id == 1) == [(1, 1), (2, 1), (3, 8)]
    assert impact_search.search(empty(spark), items).count() == 0
    none = impact_search.search(odd(spark), items.filter("item_id = 99"))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
