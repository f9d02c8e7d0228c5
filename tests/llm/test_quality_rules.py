"""The rule cascade: its sample, its order, and clashing names."""

from pyspark.sql import functions as F

from daftar.llm import quality_rules as Q

BASE = " ".join(f"word{i}" for i in range(80))


def test_sample_is_drawn_over_the_whole_table_and_whole_texts(spark):
    """Only the last rows, and only the ends of their texts, fail a rule; the sample sees them."""
    long = "plain " * 30_000
    rows = spark.range(4000).repartition(1).select(F.when(F.col("id") >= 2000, long + "<END>").otherwise("short").alias("text"))
    rule = Q.Rule("end", ~F.col("q_text").endswith("<END>"))
    ((_, seconds, share),) = Q.ordered(rows, [rule], sample_rows=200)
    assert 0.3 < share < 0.7 and seconds > 0


def test_order_is_by_rejections_per_cost_and_changes_no_verdict(spark):
    rows = spark.createDataFrame([(i, BASE if i % 2 else "#$% " * 60) for i in range(60)], "doc_id int, text string")
    rules = Q.default_rules()
    order = [r.name for r, _, _ in Q.ordered(rows, rules)]
    assert sorted(order) == sorted(r.name for r in rules) and Q.ordered(rows, rules)[0][2] > 0
    kept = {r.doc_id: r.kept for r in Q.judge(rows).collect()}
    assert kept == {r.doc_id: r.kept for r in Q.judge(rows, rules[::-1]).collect()} == {i: bool(i % 2) for i in range(60)}


def test_columns_of_clashing_names(spark):
    names = "doc_id int, text string, q_hash int, q_sorted int, q_places int, row int, n_words string, `a.b` int, kept int"
    rows = spark.createDataFrame([(1, BASE, 2, 3, 4, 5, "own", 6, 7)], names)
    got = Q.judge(rows).first()
    assert (got.q_hash, got.q_sorted, got.q_places, got.row, got["a.b"], got.n_words, got.kept) == (2, 3, 4, 5, 6, 80, True)
    assert Q.judge(rows.limit(0)).count() == 0


def test_rules_are_chosen_by_what_is_left(spark):
    """Of two rules that fail the same rows the second rejects nothing that is left, so one that fails others goes first."""
    rows = spark.createDataFrame([(BASE + (" aa" if i % 3 else "") + (" bb" if i % 9 == 0 else ""),) for i in range(90)], "text string")
    text = F.col("q_text")
    rules = [Q.Rule("a", ~text.contains(" aa")), Q.Rule("a again", ~text.contains(" aa")), Q.Rule("b", ~text.contains(" bb"))]
    order = Q.ordered(rows, rules, sample_rows=1000)
    shares = {rule.name: share for rule, _, share in order}
    assert sorted([shares["a"], shares["a again"]]) == [0.0, max(shares["a"], shares["a again"])]
    assert abs(shares["b"] - (10 / 30 if order[0][0].name != "b" else 10 / 90)) < 1e-9
    assert shares[order[-1][0].name] == 0.0 and order[-1][0].name.startswith("a")


def test_rows_that_fail_the_base_rules_are_not_sampled(spark):
    rows = spark.createDataFrame([("x",)] * 50 + [(BASE,)] * 10 + [(BASE + " #",)] * 10, "text string")
    rule = Q.Rule("symbol", ~F.col("q_text").contains("#"))
    ((_, _, share),) = Q.ordered(rows, [rule], sample_rows=1000, reach=~Q.base_failed())
    assert share == 0.5


def test_equal_rules_no_rules_and_a_very_long_line(spark):
    line = " ".join(f"w{i}" for i in range(200_000))
    rows = spark.createDataFrame([(1, line), (2, line + " #")], "doc_id int, text string")
    ends = Q.Rule("end", ~F.col("q_text").endswith("#"))
    for rules, second in (([ends, ends], False), ([], True)):
        got = {r.doc_id: (r.n_words, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in Q.judge(rows, rules).collect()}
        assert got == {1: (200_000, 0, 0, False, True), 2: (200_001, 0, 0, False, second)}
