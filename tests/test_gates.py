"""Gates, records and score comparison on hand-written frames."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import evals
from tallyloom.operators import quality as q
from tallyloom.operators import records as rec
from tallyloom.session import scratch_path
from tests.conftest import rows

ITEM = """item string, sql_text string, compile_ok boolean, run_ok boolean, actual_columns array<string>,
 total_rows long, distinct_keys long, expected_columns array<string>, expected_row_count long,
 unique_key string, tests_ok boolean"""


def item(name, text="select 1", comp=True, run=True, cols=("A", "b", "extra"), n=10, d=10,
         want=("a", "B"), count=10, key="a", tests=None):
    return (name, text, comp, run, list(cols) if cols is not None else None, n, d,
            list(want) if want is not None else None, count, key, tests)


def test_every_score_tier(spark):
    cases = {
        "no text": (item("no text", text="  "), 0.0), "null text": (item("null text", text=None), 0.0),
        "compile": (item("compile", comp=False), 0.0), "run": (item("run", run=False), 0.3),
        "missing": (item("missing", cols=["a"]), 0.6), "no table": (item("no table", cols=None), 0.6),
        "low": (item("low", n=7, d=7), 0.7), "twice": (item("twice", d=9), 0.7),
        "null key": (item("null key", n=10, d=9), 0.7), "tests fail": (item("tests fail", tests=False), 0.8),
        "tests pass": (item("tests pass", tests=True), 1.0), "full": (item("full"), 1.0),
        "nothing expected": (item("nothing expected", cols=[], want=None, count=None, key=None, n=3, d=1), 1.0),
        "empty expected": (item("empty expected", cols=[], want=[], n=10), 1.0),
    }
    df = spark.createDataFrame([c for c, _ in cases.values()], ITEM)
    scored = {r["item"]: r for r in q.score_items(df).collect()}
    assert {k: scored[k]["score"] for k in cases} == {k: s for k, (_, s) in cases.items()}
    assert not scored["missing"]["row_count_ok"] and not scored["missing"]["no_duplicates"]
    assert scored["full"]["errors"] == [] and not scored["full"]["test_ok"]
    assert scored["tests fail"]["errors"] == ["own tests fail"]
    assert scored["low"]["errors"] == ["7 rows, expected 8 to 12"]
    assert scored["twice"]["errors"] == ["a repeats: 9 values in 10 rows"]


def test_messages_are_cut(spark):
    df = spark.createDataFrame([item("x", comp=False)], ITEM).withColumn(
        "compile_message", F.repeat(F.lit("y"), F.lit(500))
    )
    assert q.score_items(df).first()["errors"] == ["not compiled: " + "y" * 200]


@pytest.mark.parametrize("expected", [0, 1, 3, 4, 7, 10, 12, 100, 503])
def test_row_bounds_truncate(spark, expected):
    low, high = int(expected * 0.8), int(expected * 1.2)
    wanted = F.lit(expected).cast("bigint")
    got = spark.range(0, high + 3).filter(q.row_count_ok(F.col("id"), wanted))
    assert [r[0] for r in got.collect()] == list(range(low, high + 1))
    assert spark.range(1).select(q.row_count_ok(F.lit(5), F.lit(None).cast("bigint"))).first()[0]


def test_null_in_the_key_fails(spark):
    df = spark.createDataFrame([("t", 1), ("t", 2), ("n", 1), ("n", None), ("d", 4), ("d", 4)], "item string, k int")
    counts = q.key_counts(df, ["item"], "k").withColumn(
        "ok", q.no_duplicates(F.col("total_rows"), F.col("distinct_keys"))
    )
    assert rows(counts) == [("d", 2, 1, False), ("n", 2, 1, False), ("t", 2, 2, True)]
    assert rows(q.duplicate_keys(df, ["item", "k"])) == [("d", 4, 2)]


def test_declared_tests(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (9, None)], "k int, v string")
    other = spark.createDataFrame([(1,), (1,)], "id int")
    got = rows(q.declared_tests(df, [
        ("unique", "k"), ("not_null", "k"), ("accepted_values", "v", ["a", "b"]),
        ("relationships", "k", other, "id"),
    ]))
    assert got == [("accepted_values:v", 1), ("not_null:k", 1), ("relationships:k", 1), ("unique:k", 1)]
    with pytest.raises(ValueError, match="unknown test"):
        q.declared_tests(df, [("positive", "k")])


def test_volume_gate_stops(spark):
    df = spark.range(5)
    enough = {"rows": (F.count("*"), 5)}
    assert q.require_volume(df, enough) is df
    with pytest.raises(q.VolumeError, match="rows: 5 < 6"):
        q.require_volume(df, {"rows": (F.count("*"), 6)})


def test_prepared_splits_check_before_they_write(spark):
    schema = """prompt string, model_name string, expected_columns array<string>,
     expected_row_count long, unique_key string"""
    data = [(f"do {i}", f"m{i}", ["a"], None, None) for i in range(20)]
    specs = spark.createDataFrame(data, schema)
    path = scratch_path(spark, "records")
    got = rec.prepare_splits(specs, path, "sys", "src", "sql", {"specs": (F.count("*"), 20)})
    assert rows(got.groupBy("split").count()) == [("test", 3), ("train", 17)]
    one = got.filter("extra_info.model_name = 'm3'").first()
    assert [m["content"] for m in one["prompt"]] == ["sys", "do 3"]
    assert one["reward_model"]["ground_truth"] == 0.0 and one["extra_info"]["schema_yml"] == ""
    missing = scratch_path(spark, "records")
    with pytest.raises(q.DuplicateNameError, match="2 duplicate values of model_name: m"):
        rec.prepare_splits(specs.unionByName(specs.limit(2)), missing, "s", "d", "a")
    with pytest.raises(q.VolumeError):
        rec.prepare_splits(specs, missing, "s", "d", "a", {"specs": (F.count("*"), 21)})


def test_first_spec_wins(spark):
    old = spark.createDataFrame([("a", 1)], "name string, id int")
    new = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3)], "name string, id int")
    assert rows(q.merge_first_wins(old, new, "name", ["id"])) == [("a", 1), ("b", 3)]


# --- text -------------------------------------------------------------------

#: A text, its fenced block, and its strict, first and fallback answers.
TEXTS = [
    ("", "", None, None, ""),
    ("  plain \n", "plain", None, None, ""),
    ("```sql\nselect 1\n```", "select 1", None, None, "select 1"),
    ("```sql  \n\n```", "", None, None, ""),
    ("```sql\n``` and ```\nx\n```", "", None, None, ""),
    ("```\na\n``` then ```sql\nb\n```", "b", None, None, "a"),
    ("```python\nx\n```", "```python\nx\n```", None, None, ""),
    ("``` sql\nx```", "``` sql\nx```", None, None, ""),
    ("```sql select 1```", "```sql select 1```", None, None, ""),
    ("<answer>a</answer>", "<answer>a</answer>", "a", "a", "a"),
    ("<answer>a</answer><answer>b</answer>", "<answer>a</answer><answer>b</answer>", None, "a", "a"),
    ("<answer> </answer>", "<answer> </answer>", None, None, ""),
    ("<answer>```sql\nq\n```</answer>", "q", "q", "q", "q"),
    ("<answer>x ```\nq\n``` y</answer>", "q", "q", "q", "q"),
    ("<answer>open", "<answer>open", None, None, ""),
    ("\xa0<answer> q\x1f</answer>", "<answer> q\x1f</answer>", "q", "q", "q"),
    ("``` \nwide\x85\n```", "wide", None, None, "wide"),
    ("</answer><answer>z</answer>", "</answer><answer>z</answer>", "z", "z", "z"),
    ("<answer>```sql\n```</answer>", "", None, None, ""),
    ("<answer>a\r\nb</answer>```sql\nno\n```", "no", "a\r\nb", "a\r\nb", "a\r\nb"),
]


def extracted(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    got = df.select("i", rec.fenced_block(t), *[rec.answer(t, m) for m in ("strict", "first", "fallback")])
    return [tuple(r)[1:] for r in got.orderBy("i").collect()]


def test_extraction_rules(spark):
    assert extracted(spark, [t for t, *_ in TEXTS]) == [tuple(found) for _, *found in TEXTS]


PIECES = st.sampled_from(
    ["```", "sql", "\n", " ", "<answer>", "</answer>", "select 1", "\t", " ", "\x1c", " ", "x"]
)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=60, max_size=60))
def test_extraction_on_random_texts(spark, texts):
    """What holds for any text: no outer blanks, a strict answer is the first
    one, no answer means NULL, and nothing is invented."""
    for text, (block, strict, first, fallback) in zip(texts, extracted(spark, texts), strict=True):
        for found in (block, strict, first, fallback):
            assert found is None or (found == found.strip() and found in text)
        assert strict in (None, first) and first in (None, fallback)
        closed = text.find("</answer>", text.find("<answer>") + 8) if "<answer>" in text else -1
        if closed < 0:
            assert strict is None and first is None
        if text.count("<answer>") > 1 and text.count("</answer>") > 1 and closed >= 0:
            rest = text[closed + 9 :]
            if "<answer>" in rest and "</answer>" in rest[rest.find("<answer>") + 8 :]:
                assert strict is None, "two answers are not one"
        if "```" not in text:
            assert block == text.strip()


def test_long_texts_are_read_whole(spark):
    body = "select " + "x, " * 60_000 + "1"
    text = "lead " * 10_000 + f"<answer>```sql\n{body}\n```</answer>"
    assert extracted(spark, [text])[0] == (body, body, body, body)


def test_task_classes(spark):
    texts = {
        "FIX the join": "debug", "Add a Test to it": "config", "split this select": "multi_file",
        "Please JOIN": "sql_generation", "prefix": "debug", "hello": "other", None: "other",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(rec.task_class(F.col("t"))).collect()] == list(texts.values())


def test_prompts_without_schema_or_tables(spark):
    df = spark.createDataFrame(
        [("do", None), ("do", {}), ("do", {"t": {"columns": {"A": "INT"}}})],
        "i string, s map<string, struct<columns: map<string, string>>>",
    )
    got = [r[0] for r in df.select(rec.schema_prompt(F.col("i"), F.col("s"), "end")).collect()]
    assert got[0] == got[1] == "Task: do\n\nend"
    assert got[2].endswith("### t\n| Column | Type |\n|--------|------|\n| A | INT |\n\nend")
    holes = spark.sql("""SELECT map('t', named_struct('columns', map('A', CAST(NULL AS STRING)))) AS s,
      map('x', array('a', NULL), 'y', CAST(NULL AS ARRAY<STRING>)) AS m,
      array(named_struct('name', 'z', 'columns', CAST(NULL AS STRING))) AS l""")
    shown = holes.select(
        rec.schema_prompt(F.lit("do"), F.col("s"), "end"), rec.metadata_lines(F.col("m")),
        rec.metadata_lines(F.col("l"), "list"),
    ).first()
    assert "| A | None |\n" in shown[0]
    assert shown[1] == ["  - x: a, None", "  - y: None"] and shown[2] == ["  - z: None"]
    targets = [tuple(r[0]) for r in df.select(rec.target_of(F.col("s"))).collect()]
    assert targets == [("generated_model", []), ("generated_model", []), ("t", ["a"])]


@pytest.mark.parametrize(("n", "train"), [(505, 429), (1, 0), (20, 17), (0, 0)])
def test_exact_split_size_and_stability(spark, n, train):
    df = spark.range(n)
    one = rows(rec.exact_split(df, "id"))
    two = rows(rec.exact_split(df.repartition(5), "id"))
    assert one == two and len({r[0] for r in one}) == n
    assert sorted(r[2] for r in one if r[1] == "train") == list(range(train))
    assert sorted(r[2] for r in one if r[1] == "test") == list(range(n - train))
    if n > 100:
        assert one != rows(rec.exact_split(df, "id", seed=7))


# --- scores -----------------------------------------------------------------



# The published scores of 12 items; arm A under the permissive
# and the strict scorer, then arm B under both.
PUBLISHED = [
    (1.0, 1.0, 1.0, 1.0),
    (1.0, 1.0, 1.0, 1.0),
    (1.0, 0.0, 1.0, 0.6),
    (0.6, 0.0, 0.6, 0.0),
    (0.6, 0.0, 0.6, 0.6),
    (0.6, 0.6, 0.6, 0.6),
    (0.0, 0.0, 0.6, 0.6),
    (1.0, 0.6, 0.6, 0.6),
    (0.6, 0.6, 0.6, 0.0),
    (0.0, 0.0, 1.0, 1.0),
    (0.6, 0.6, 0.0, 0.0),
    (0.3, 0.0, 0.6, 0.6),
]


def test_published_scores(spark):
    """Means and divergent items follow from the item table (the published
    """
    cells = [("a", "p"), ("a", "s"), ("b", "p"), ("b", "s")]
    data = [(m, s, i, v) for i, row in enumerate(PUBLISHED) for (m, s), v in zip(cells, row, strict=True)]
    df = spark.createDataFrame(data, "model string, scorer string, item int, score double")
    means = {(r[0], r[1]): round(r[2], 3) for r in evals.mean_scores(df).collect()}
    assert [means[c] for c in cells] == [0.608, 0.367, 0.683, 0.55]
    assert rows(evals.divergence(df, "p", "s")) == [("a", 5, 12), ("b", 3, 12)]


def test_scores_with_failures(spark):
    data = [
        ("a", "p", 1, 1.0), ("a", "s", 1, 0.6), ("a", "p", 2, 0.7), ("a", "s", 2, 0.6),
        ("a", "p", 3, -1.0), ("a", "s", 3, 0.3), ("b", "p", 1, 0.3), ("b", "s", 1, 0.3),
    ]
    df = spark.createDataFrame(data, "model string, scorer string, item int, score double")
    means = {(r[0], r[1]): (round(r[2], 6), r[3], r[4]) for r in evals.mean_scores(df).collect()}
    assert means["a", "p"] == (0.85, 2, 1) and means["a", "s"] == (0.5, 3, 0)
    # 0.7 and 0.6 are 0.1 apart in decimals, not further; a failed side never diverges.
    assert rows(evals.divergence(df, "p", "s")) == [("a", 1, 3), ("b", 0, 1)]
    assert rows(evals.matrix(df, ["a", "b"], ["p", "s"])) == [
        (1, 1.0, 0.6, 0.3, 0.3), (2, 0.7, 0.6, None, None), (3, -1.0, 0.3, None, None)]
    delta = {r["scorer"]: r["relative_delta"] for r in evals.relative_delta(evals.mean_scores(df), "a", "b").collect()}
    assert delta == {"p": round((0.3 - 0.85) / 0.85, 6), "s": -0.4}


def test_exact_split_keeps_null_keys(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), (None,)], "k string")
    got = rec.exact_split(df, "k", test_ratio=0.5)
    assert rows(got.groupBy("split").count()) == [("test", 2), ("train", 2)]
    assert got.filter("k IS NULL").count() == 2
