from pyspark.sql import functions as F

from pagewright.llm import quality_rules, source_mixing


def repeat_words(words):
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({p + k for places in at.values() if len(places) > 1 for p in places for k in range(5)})


def test_measures(spark):
    texts = [None, "", "one", "a b c d e", "a b c d e a b c d e", "x " * 5000, "p q r s t u " * 3 + "z", "line one here\nline one here\n\n  \nline two | #", "é 漢字 😀 a b c", "a b c d e f a b c d e g a b c d e"]
    df = spark.createDataFrame([(i, t, "s1" if i % 2 else None, 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, host int")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = (t or "").split()
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), repeat_words(w)), t
        assert got[i].word_chars == sum(map(len, w))
        assert got[i].base_failed == (len(w) < 10 or 100 * repeat_words(w) > 20 * len(w))
    assert (got[7].n_dup_lines, got[7].n_symbols) == (1, 2)
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_packed_places_fall_back(spark, monkeypatch):
    # one bit of hash beside the place: different windows meet, the structs decide
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 62)
    text = "a b c d e f a b c d e g h i j a b c d e k l m n o p q r s t u v w x y z"
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert quality_rules.judge(df).first().n_repeat_words == repeat_words(text.split())


def test_host_verdicts_and_salted_join(spark, monkeypatch):
    good, bad = " ".join(f"w{k}" for k in range(40)), "short"
    rows = [(i, bad if i % 10 else good, "junk") for i in range(60)] + [(100 + i, good, f"h{i % 6}") for i in range(120)] + [(300, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    assert not any(one[i] for i in range(60)) and all(one[i] for i in [*range(100, 220), 300])
    monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", 1)
    assert {r.doc_id: r.kept for r in quality_rules.judge(df).collect()} == one
    assert quality_rules.keep_good(df).columns == df.columns


def levels():
    return {"a": F.col("a"), "b": F.col("b")}, {"a": F.when(F.col("a") == "x", 3).otherwise(1), "b": F.lit(1)}


def test_budgets_go_to_siblings_first(spark):
    rows = [(1, "w " * 10, "x", "p"), (2, "w " * 1000, "x", "q"), (3, "w " * 1000, "y", "r"), (4, None, "y", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, b string")
    keys, weights = levels()
    got = {r.b: r.full_epochs * r.n_tokens + r.part_tokens for r in source_mixing.mix(df, keys, weights, budget=(1, 2), carry=["doc_id"]).collect()}
    # 1005 tokens: x gets 753 (p only has 10, so q takes the rest), y gets 252
    assert got == {"p": 10, "q": 744, "r": 251, "s": 0} or got == {"p": 10, "q": 743, "r": 252, "s": 0}
    assert sum(got.values()) == 1005


def test_take(spark):
    rows = [(i, " ".join(f"t{i}_{k}" for k in range(7)), "x" if i % 3 else "y", None if i % 5 == 0 else "p") for i in range(60)] + [(99, "", "x", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, b string")
    keys, weights = levels()
    for budget, epochs in (((1, 3), 1), ((3, 2), 2), ((1, 1), 1)):
        got = source_mixing.take(df, keys, weights, budget=budget, max_epochs=epochs)
        assert got.columns == df.columns
        texts = [r.text for r in got.collect()]
        assert sum(len(t.split()) for t in texts) == min(420 * budget[0] // budget[1], 420 * epochs)
        assert all(any(t2.startswith(t) for _, t2, *_ in rows) and t for t in texts)
        again = [r.text for r in source_mixing.take(df, keys, weights, budget=budget, max_epochs=epochs).collect()]
        assert sorted(texts) == sorted(again)
    assert source_mixing.mix(df.limit(0), keys, weights).count() == 0


def test_rules_on_repeated_rows_null_ids_and_clashing_columns(spark):
    good = " ".join(f"w{k}" for k in range(40))
    rows = [(1, good, "a", 5, False, True), (1, good, "a", 5, False, True), (None, good, "a", 5, False, True), (None, "few words", None, 5, False, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, kept boolean, base_failed boolean")
    got = sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in quality_rules.judge(df).collect())
    assert got == [("1", 40, False, True), ("1", 40, False, True), ("None", 2, True, False), ("None", 40, False, True)]
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and sorted(str(tuple(r)) for r in kept.collect()) == sorted(str(r) for r in rows[:3])
    assert quality_rules.judge(df.limit(0)).collect() == [] and quality_rules.keep_good(df.limit(0)).columns == df.columns


def test_mixing_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a b c d", "x", "p", 9, 9), (1, "a b c d", "x", "p", 9, 9), (None, "e f", "x", None, 9, 9), (2, "", "y", "p", 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, b string, budget int, n_tokens int")
    keys, weights = levels()
    every = source_mixing.take(df, keys, weights, budget=(1, 1), max_epochs=1)
    assert every.columns == df.columns and sorted(str(tuple(r)) for r in every.collect()) == sorted(str(r) for r in rows[:3])
    part = [r.text for r in source_mixing.take(df, keys, weights, budget=(1, 2), max_epochs=1).collect()]
    assert sum(len(t.split()) for t in part) == 5
    assert source_mixing.take(df.limit(0), keys, weights).collect() == []
