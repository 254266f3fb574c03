import re

import numpy as np

from wavecohort.llm import quality_rules as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)


ODD = [None, "", " \n", "a", "é 漢字 🙂 x", "one two three four five " * 4, "x\nx\nx\n \n", "# * $%&|<> ok", "a b c d e f a b c d e g", "word " * 12, "same line\nsame line \nsame line", "q" * 200_000]


def test_counts_equal_the_plain_ones(spark, sf):
    rows = list(enumerate(ODD)) + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows] + [(None, "a", 7)], "doc_id long, text string, n_words int")
    for r in Q.assessed(docs, Q.DecisionList(())).collect():
        want = plain(dict(rows).get(r.doc_id, "a"))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed)
    assert Q.assessed(docs.limit(0), Q.DecisionList(())).count() == 0


def test_rules_are_found_and_precise():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["c"] > 0.95)
    found = Q.learn(x, bad)
    assert 2 <= len(found.rules) <= 12
    gone = found.rejects(x)
    assert (gone & bad).sum() > 0.9 * bad.sum() and (gone & ~bad).sum() < 0.05 * gone.sum()
    assert Q.learn(x, np.zeros(3000, bool)).rules == ()
    assert Q.learn(x, rng.random(3000) < 0.3).rules == ()  # nothing to learn spares everything


def test_expression_is_the_list(spark):
    x = {"a": np.array([0.1, 0.6, 0.9]), "b": np.array([5.0, 1.0, 5.0])}
    rules = Q.DecisionList(((Q.Condition("a", True, 0.5), Q.Condition("b", False, 2.0)), (Q.Condition("a", True, 0.9),)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(zip(x["a"].tolist(), x["b"].tolist())), "a double, b double")
    assert [r.k for r in df.select(rules.expression({"a": F.col("a"), "b": F.col("b")}).alias("k")).collect()] == (~rules.rejects(x)).tolist()


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = Q.learn_from(docs, labels)
    assert rules == Q.learn_from(docs.repartition(5), labels.repartition(3))
    out = Q.assessed(docs, rules).join(labels, "doc_id").collect()
    good, bad = [r for r in out if r.quality == 1 and not r.base_failed], [r for r in out if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(not r.kept for r in bad) >= 0.7 * len(bad)
    kept = Q.keep_good(docs, rules)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in Q.assessed(docs, rules).collect())
    assert Q.learn_from(docs, labels.limit(0)) == Q.DecisionList(())
