"""Table gates, text and record preparation, comparison of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.dates import as_date
from tallyloom.functions.money import to_minor
from tallyloom.operators import evals
from tallyloom.operators import quality as q
from tallyloom.operators import records as rec
from tallyloom.operators.windows import join_beside
from tallyloom.plans.registry import model
from tallyloom.plans.shop import n_rows
from tallyloom.session import scratch_path

# --- table gates ------------------------------------------------------------

EXPECTED = ["Click", "view", "purchase"]


@model("qlt_01_expected_columns", """
WITH i AS (SELECT user_id, CAST(ts AS DATE) AS day, list(DISTINCT upper(event_type)) AS actual FROM events GROUP BY 1, 2)
SELECT user_id, day, list_contains(actual, 'CLICK') AND list_contains(actual, 'VIEW') AND list_contains(actual, 'PURCHASE') AS columns_ok,
       CAST(3 - list_contains(actual, 'CLICK')::INT - list_contains(actual, 'VIEW')::INT - list_contains(actual, 'PURCHASE')::INT AS BIGINT) AS missing
FROM i
""")
def expected_columns(t):
    """Each user's day is a table; the event types seen are its columns."""
    day = as_date(F.col("ts")).alias("day")
    present = t.events.select("user_id", day, F.upper("event_type").alias("column_name")).distinct()
    tables = present.groupBy("user_id", "day").agg(F.collect_set("column_name").alias("actual"))
    wanted = F.array(*[F.lit(c) for c in EXPECTED])
    expected = tables.select("user_id", "day", F.explode(wanted).alias("column_name"))
    lost = q.missing_columns(present, expected, ["user_id", "day"])
    lost = lost.groupBy("user_id", "day").agg(n_rows().alias("missing"))
    return join_beside(tables, lost, ["user_id", "day"], "left").select(
        "user_id", "day", q.columns_ok(wanted, F.col("actual")).alias("columns_ok"),
        F.coalesce("missing", F.lit(0)).alias("missing"),
    )


@model("qlt_02_row_count", """
WITH n AS (SELECT l_suppkey AS item, COUNT(*) AS total_rows FROM lineitem GROUP BY 1)
SELECT item, total_rows, total_rows BETWEEN CAST(TRUNC(603 * (1 - 0.04::DOUBLE)) AS BIGINT)
       AND CAST(TRUNC(603 * (1 + 0.04::DOUBLE)) AS BIGINT) AS row_count_ok FROM n
""")
def row_counts(t, expected: int = 603, tolerance: float = 0.04):
    counts = t.lineitem.groupBy(F.col("l_suppkey").alias("item")).agg(n_rows().alias("total_rows"))
    wanted = F.lit(expected).cast("bigint")
    ok = q.row_count_ok(F.col("total_rows"), wanted, tolerance)
    return counts.withColumn("row_count_ok", ok)


@model("qlt_03_duplicates", """
SELECT d.source AS item, COUNT(*) AS total_rows, COUNT(DISTINCT l.doc_id) AS distinct_keys,
       COUNT(*) = COUNT(DISTINCT l.doc_id) AS no_duplicates
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND d.lang <> 'de' GROUP BY 1
""")
def duplicates(t):
    """The label's document id is the key; unlabelled rows leave it NULL."""
    labels = t.labels.select("doc_id", F.col("doc_id").alias("label_key"))
    keyed = F.coalesce(F.col("lang") != "de", F.lit(False))
    other = t.documents.filter(keyed).join(labels, "doc_id", "left")
    rest = t.documents.filter(~keyed).withColumn("label_key", F.lit(None).cast("bigint"))
    rows = other.select("source", "label_key").unionByName(rest.select("source", "label_key"))
    counts = q.key_counts(rows.withColumnRenamed("source", "item"), ["item"], "label_key")
    unique = q.no_duplicates(F.col("total_rows"), F.col("distinct_keys"))
    return counts.withColumn("no_duplicates", unique)


GATED = """
WITH n AS (SELECT l_orderkey AS k, COUNT(*) AS total_rows, COUNT(DISTINCT l_partkey) AS distinct_keys,
                  bool_or(l_returnflag = 'R') AS any_returned, bool_or(l_returnflag = 'A') AS any_a,
                  bool_or(l_returnflag = 'N') AS any_n
           FROM lineitem GROUP BY 1),
 i AS (SELECT o_orderkey AS item_id, COALESCE(o_orderpriority <> '4-NOT SPECIFIED', FALSE) AS has_text,
              COALESCE(o_orderstatus <> 'P', FALSE) AS compile_ok, COALESCE(o_totalprice > 50000, FALSE) AS run_ok,
              COALESCE(any_a, FALSE) AND COALESCE(any_n, FALSE) AS columns_ok,
              COALESCE(total_rows, 0) AS total_rows, COALESCE(distinct_keys, 0) AS distinct_keys,
              any_returned AS tests_ok
       FROM orders LEFT JOIN n ON o_orderkey = k),
 s AS (SELECT *, total_rows BETWEEN 4 AND 6 AS row_count_ok, total_rows = distinct_keys AS uniq FROM i)
"""


def gated_orders(t):
    """Every order is an item; its lines are the result table to check."""
    flag = F.col("l_returnflag")
    flags = ["A", "N", "R"]
    # Per order and part first: the distinct parts are then a plain count.
    per_part = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(
        n_rows().alias("n"), *[F.max(flag == f).alias(f"has_{f}") for f in flags]
    )
    lines = per_part.groupBy("l_orderkey").agg(
        F.sum("n").alias("total_rows"),
        F.count("l_partkey").alias("distinct_keys"),
        F.max("has_R").alias("tests_ok"),
        F.array_compact(F.array(*[F.when(F.max(f"has_{f}"), f) for f in flags])).alias(
            "actual_columns"
        ),
    )
    joined = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    unspecified = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    items = joined.select(
        F.col("o_orderkey").alias("item_id"),
        F.when(unspecified, "").otherwise(F.col("o_orderpriority")).alias("sql_text"),
        (F.col("o_orderstatus") != "P").alias("compile_ok"),
        (F.col("o_totalprice") > 50000).alias("run_ok"),
        "actual_columns", F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.coalesce("distinct_keys", F.lit(0)).alias("distinct_keys"), "tests_ok",
        F.array(F.lit("a"), F.lit("n")).alias("expected_columns"),
        F.lit(5).cast("bigint").alias("expected_row_count"),
        F.lit("l_partkey").alias("unique_key"),
        F.repeat(F.lit("pending "), F.lit(40)).alias("compile_message"),
    )
    return q.score_items(items)


@model("qlt_04_tiered_score", GATED + """
SELECT item_id, CAST(CASE WHEN NOT has_text OR NOT compile_ok THEN 0.0 WHEN NOT run_ok THEN 0.3 WHEN NOT columns_ok THEN 0.6
  WHEN NOT (row_count_ok AND uniq) THEN 0.7 WHEN tests_ok IS NOT NULL AND NOT tests_ok THEN 0.8 ELSE 1.0 END AS DOUBLE) AS score
FROM s
""")
def tiered(t):
    return gated_orders(t).select("item_id", "score")


@model("qlt_05_batch_score", """
WITH n AS (SELECT l_suppkey AS item_id, COUNT(*) AS total_rows, COUNT(DISTINCT l_orderkey) AS distinct_keys FROM lineitem GROUP BY 1)
SELECT item_id, total_rows BETWEEN 480 AND 720 AS row_count_ok, total_rows = distinct_keys AS no_duplicates,
       CAST(CASE WHEN total_rows BETWEEN 480 AND 720 AND total_rows = distinct_keys THEN 1.0 ELSE 0.7 END AS DOUBLE) AS score
FROM n
""")
def batch(t):
    """Every supplier's lines are one result table; optional fields are left out."""
    rows = t.lineitem.withColumnRenamed("l_suppkey", "item_id")
    items = q.key_counts(rows, ["item_id"], "l_orderkey").select(
        "*", F.lit("select 1").alias("sql_text"), F.lit(True).alias("compile_ok"),
        F.lit(True).alias("run_ok"), F.array(F.lit("l_orderkey")).alias("actual_columns"),
        F.lit(600).cast("bigint").alias("expected_row_count"), F.lit("l_orderkey").alias("unique_key"),
    )
    return q.score_items(items).select("item_id", "row_count_ok", "no_duplicates", "score")


@model("qlt_06_declared_tests", """
SELECT 'not_null:o_custkey' AS test, COUNT(*) FILTER (o_custkey IS NULL) AS failures FROM orders
UNION ALL SELECT 'accepted_values:o_orderstatus', COUNT(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders
UNION ALL SELECT 'unique:o_custkey', COUNT(*) FROM (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1)
UNION ALL SELECT 'relationships:o_orderkey', COUNT(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
""")
def declared(t):
    return q.declared_tests(t.orders, [
        ("not_null", "o_custkey"),
        ("accepted_values", "o_orderstatus", ["F", "O"]),
        ("unique", "o_custkey"),
        ("relationships", "o_orderkey", t.lineitem, "l_orderkey"),
    ])


@model("qlt_07_error_list", GATED + """
SELECT item_id, concat_ws('; ',
  CASE WHEN NOT has_text THEN 'no SQL in the answer' END,
  CASE WHEN has_text AND NOT compile_ok THEN 'not compiled: ' || left(repeat('pending ', 40), 200) END,
  CASE WHEN has_text AND compile_ok AND NOT run_ok THEN 'not run: ' END,
  CASE WHEN has_text AND compile_ok AND run_ok AND NOT columns_ok THEN 'columns are missing' END,
  CASE WHEN has_text AND compile_ok AND run_ok AND columns_ok AND NOT row_count_ok THEN total_rows || ' rows, expected 4 to 6' END,
  CASE WHEN has_text AND compile_ok AND run_ok AND columns_ok AND NOT uniq THEN 'l_partkey repeats: ' || distinct_keys || ' values in ' || total_rows || ' rows' END,
  CASE WHEN has_text AND compile_ok AND run_ok AND columns_ok AND row_count_ok AND uniq AND NOT tests_ok THEN 'own tests fail' END) AS errors
FROM s
""")
def error_list(t):
    return gated_orders(t).select("item_id", F.array_join("errors", "; ").alias("errors"))


@model("qlt_08_duplicate_names", """
SELECT md5(text) AS name, COUNT(*) AS row_count FROM documents GROUP BY 1 HAVING COUNT(*) > 1
""")
def duplicate_names(t):
    return q.duplicate_keys(t.documents.select(F.md5("text").alias("name")), ["name"])


def volumes():
    return {
        "documents": (n_rows(), 400),
        "sources": (F.countDistinct("source"), 21),
        "english": (F.count_if(F.col("lang") == "en"), 100),
    }


@model("qlt_09_volume_gate", """
SELECT 'documents' AS gate, COUNT(*) AS actual, 400::BIGINT AS minimum, COUNT(*) >= 400 AS ok FROM documents UNION ALL
SELECT 'sources', COUNT(DISTINCT source), 21, COUNT(DISTINCT source) >= 21 FROM documents UNION ALL
SELECT 'english', COUNT(*) FILTER (lang = 'en'), 100, COUNT(*) FILTER (lang = 'en') >= 100 FROM documents
""")
def volume_gate(t):
    return q.volume_gate(t.documents, volumes())


@model("qlt_10_first_wins_merge", """
WITH e AS (SELECT md5(text) AS name, 'benchmark' AS origin, item_id AS spec_id FROM benchmark),
     b AS (SELECT md5(text) AS name, 'documents' AS origin, doc_id AS spec_id FROM documents
           WHERE COALESCE(md5(text) NOT IN (SELECT name FROM e), true))
SELECT * FROM e UNION ALL SELECT * FROM b QUALIFY name IS NULL OR ROW_NUMBER() OVER (PARTITION BY name ORDER BY spec_id) = 1
""".replace("SELECT * FROM e UNION ALL SELECT * FROM b QUALIFY", "SELECT * FROM e UNION ALL (SELECT * FROM b QUALIFY").rstrip() + ")")
def first_wins(t):
    def specs(df, origin, key):
        return df.select(
            F.md5("text").alias("name"), F.lit(origin).alias("origin"), F.col(key).alias("spec_id")
        )

    existing = specs(t.benchmark, "benchmark", "item_id")
    return q.merge_first_wins(
        existing, specs(t.documents, "documents", "doc_id"), "name", ["spec_id"]
    )


# --- text -------------------------------------------------------------------

WS = rec.WHITESPACE


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+\\z', '', 'g')"


def sql_first(expr: str, pattern: str) -> str:
    return (
        f"CASE WHEN regexp_matches({expr}, '{pattern}') "
        f"THEN {sql_strip(f'''regexp_extract({expr}, '{pattern}', 1)''')} END"
    )


FENCED_SQL = """(SELECT conv_id, turn, CASE role
  WHEN 'user' THEN 'Here:' || chr(10) || '```sql ' || chr(10) || text || chr(10) || '``` done'
  WHEN 'assistant' THEN '```' || chr(10) || ' ' || text || '```' || chr(10) || '```' || chr(10) || 'second```'
  ELSE '  ' || text || chr(10) END AS completion FROM conversations)"""


def fenced(t):
    text = F.col("text")
    return t.conversations.select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", F.concat(F.lit("Here:\n```sql \n"), text, F.lit("\n``` done")))
        .when(F.col("role") == "assistant", F.concat(F.lit("```\n "), text, F.lit("```\n```\nsecond```")))
        .otherwise(F.concat(F.lit("  "), text, F.lit("\n")))
        .alias("completion"),
    )


@model("txt_01_fenced_block", f"""
SELECT conv_id, turn, COALESCE({sql_first('completion', rec.SQL_FENCE)}, {sql_first('completion', rec.PLAIN_FENCE)},
  {sql_strip('completion')}) AS sql_text FROM {FENCED_SQL}
""")
def fenced_block(t):
    return fenced(t).select("conv_id", "turn", rec.fenced_block(F.col("completion")).alias("sql_text"))


ANSWERED_SQL = """(SELECT conv_id, turn, CASE role
  WHEN 'user' THEN 'so <answer>' || chr(10) || text || ' </answer>'
  WHEN 'assistant' THEN '<answer>' || text || '</answer> or <answer> none </answer>'
  ELSE '<answer>```sql' || chr(10) || text || chr(10) || '```</answer>' END AS completion FROM conversations
  UNION ALL SELECT item_id, -1, CASE WHEN length(text) > 400 THEN '```' || chr(10) || text || '```' ELSE '<answer> </answer>' END FROM benchmark)"""


def answered(t):
    text, role = F.col("text"), F.col("role")
    spoken = t.conversations.select(
        "conv_id", "turn",
        F.when(role == "user", F.concat(F.lit("so <answer>\n"), text, F.lit(" </answer>")))
        .when(role == "assistant", F.concat(
            F.lit("<answer>"), text, F.lit("</answer> or <answer> none </answer>")))
        .otherwise(F.concat(F.lit("<answer>```sql\n"), text, F.lit("\n```</answer>")))
        .alias("completion"),
    )
    other = t.benchmark.select(
        F.col("item_id").alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"),
        F.when(F.length(text) > 400, F.concat(F.lit("```\n"), text, F.lit("```")))
        .otherwise("<answer> </answer>")
        .alias("completion"),
    )
    return spoken.unionByName(other)


BODY = f"(SELECT *, regexp_extract_all(completion, '{rec.ANSWER}', 1) AS blocks FROM {ANSWERED_SQL})"
BODY = f"(SELECT *, {sql_strip('blocks[1]')} AS raw FROM {BODY})"
BODY = f"(SELECT *, COALESCE({sql_first('raw', rec.ANY_FENCE)}, raw) AS body FROM {BODY})"


@model("txt_02_single_answer", f"""
SELECT conv_id, turn, CASE WHEN len(blocks) = 1 THEN NULLIF(body, '') END AS sql_text FROM {BODY}
""")
def single_answer(t):
    return answered(t).select("conv_id", "turn", rec.answer(F.col("completion")).alias("sql_text"))


@model("txt_03_lenient_answer", f"""
SELECT conv_id, turn, NULLIF(body, '') AS first_text,
       COALESCE(body, {sql_first('completion', rec.ANY_FENCE)}, '') AS fallback_text FROM {BODY}
""")
def lenient_answer(t):
    c = F.col("completion")
    return answered(t).select(
        "conv_id", "turn", rec.answer(c, "first").alias("first_text"),
        rec.answer(c, "fallback").alias("fallback_text"),
    )


TASKS_SQL = """(SELECT conv_id * 100 + turn AS task_id, CASE role WHEN 'user' THEN 'Please create a model: '
  WHEN 'assistant' THEN 'Set up sources for ' ELSE 'Say ' END || text AS instruction FROM conversations
  UNION ALL SELECT 1000000000 + doc_id, text FROM documents)"""


def tasks(t):
    role, text = F.col("role"), F.col("text")
    lead = (
        F.when(role == "user", "Please create a model: ")
        .when(role == "assistant", "Set up sources for ")
        .otherwise("Say ")
    )
    spoken = t.conversations.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("task_id"),
        F.concat(lead, text).alias("instruction"),
    )
    written = t.documents.select(
        (F.col("doc_id") + 1_000_000_000).alias("task_id"), text.alias("instruction")
    )
    return spoken.unionByName(written)


def sql_class(expr: str) -> str:
    arms = [
        "WHEN " + " OR ".join(f"contains(lower({expr}), '{w}')" for w in words) + f" THEN '{name}'"
        for name, words in rec.TASK_CLASSES
    ]
    return f"CASE {' '.join(arms)} ELSE 'other' END"


@model("txt_04_task_class", f"SELECT task_id, {sql_class('instruction')} AS category FROM {TASKS_SQL}")
def task_class(t):
    return tasks(t).select("task_id", rec.task_class(F.col("instruction")).alias("category"))


@model("txt_05_class_report", f"""
WITH c AS (SELECT *, {sql_class('instruction')} AS category FROM {TASKS_SQL}),
     n AS (SELECT category, COUNT(*) AS task_count FROM c GROUP BY 1)
SELECT category, task_count, ROW_NUMBER() OVER (PARTITION BY category ORDER BY task_id) AS sample_no,
       task_id, left(instruction, 80) AS sample
FROM c JOIN n USING (category) QUALIFY sample_no <= 3
""")
def class_report(t):
    return rec.class_report(tasks(t), "task_id", "instruction")


@model("txt_05_class_filter", f"SELECT task_id FROM {TASKS_SQL} WHERE {sql_class('instruction')} = 'sql_generation'")
def class_filter(t):
    return rec.tasks_of_class(tasks(t), "instruction").select("task_id")


CLOSING = "Answer with one SELECT for the first table above."


def two_tables():
    """A schema map of two tables; the second one stays out for short texts."""
    def spec(*pairs):
        return F.struct(F.create_map(*pairs).alias("columns"))

    first = F.map_from_arrays(
        F.array("source"), F.array(spec(F.lit("Doc_ID"), F.lit("BIGINT"), F.lit("TEXT"), F.lit("VARCHAR")))
    )
    second = F.map_from_arrays(
        F.array(F.concat(F.col("source"), F.lit("_stats"))),
        F.array(spec(F.lit("n_chars"), F.col("lang"), F.lit("ratio"), F.lit("DOUBLE"))),
    )
    return F.when(F.col("n_chars") >= 400, F.map_concat(first, second)).when(
        F.col("n_chars") >= 100, first
    )


@model("txt_06_schema_prompt", f"""
WITH d AS (SELECT *, '### ' || source || chr(10) || '| Column | Type |' || chr(10) || '|--------|------|' || chr(10)
  || '| Doc_ID | BIGINT |' || chr(10) || '| TEXT | VARCHAR |' || chr(10) || chr(10) AS a,
  '### ' || source || '_stats' || chr(10) || '| Column | Type |' || chr(10) || '|--------|------|' || chr(10)
  || '| n_chars | ' || COALESCE(lang, 'None') || ' |' || chr(10) || '| ratio | DOUBLE |' || chr(10) || chr(10) AS b,
  '## REQUIRED OUTPUT SCHEMA' || chr(10) || chr(10) || 'The result must match this exact schema:' || chr(10) || chr(10) AS h FROM documents)
SELECT doc_id, 'Task: ' || text || chr(10) || chr(10) || CASE WHEN n_chars >= 400 THEN h || a || b WHEN n_chars >= 100 THEN h || a ELSE '' END
  || '{CLOSING}' AS prompt FROM d
""")
def schema_prompt(t):
    prompt = rec.schema_prompt(F.col("text"), two_tables(), CLOSING)
    return t.documents.select("doc_id", prompt.alias("prompt"))


@model("txt_07_metadata_prompt", """
SELECT doc_id, text || COALESCE(chr(10) || chr(10) || 'Expected output schema:' || chr(10) || lang, '')
   || chr(10) || chr(10) || 'Available tables:' || chr(10) || '  - ' || source || ': doc_id, text' || chr(10) || '  - lang: ' || COALESCE(lang, 'None') AS map_prompt,
   text || chr(10) || chr(10) || 'Available tables:' || chr(10) || '  - ' || source || ': ' || COALESCE(lang, 'None') AS list_prompt
FROM documents
""")
def metadata_prompt(t):
    as_map = F.map_from_arrays(
        F.array(F.col("source"), F.lit("lang")),
        F.array(F.array(F.lit("doc_id"), F.lit("text")), F.array("lang")),
    )
    as_list = F.array(F.struct(F.col("source").alias("name"), F.col("lang").alias("columns")))
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        rec.metadata_prompt(text, F.col("lang"), rec.metadata_lines(as_map)).alias("map_prompt"),
        rec.metadata_prompt(text, F.lit(""), rec.metadata_lines(as_list, "list")).alias("list_prompt"),
    )


@model("txt_08_target_table", """
SELECT doc_id, CASE WHEN n_chars >= 100 THEN source ELSE 'generated_model' END AS model_name,
       CASE WHEN n_chars >= 100 THEN 'doc_id,text' ELSE '' END AS expected_columns FROM documents
""")
def target_table(t):
    target = t.documents.select("doc_id", rec.target_of(two_tables()).alias("target"))
    return target.select(
        "doc_id", "target.model_name",
        F.array_join("target.expected_columns", ",").alias("expected_columns"),
    )


# --- records ----------------------------------------------------------------

SPLIT_SQL = """
WITH p AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place,
                  CAST(TRUNC(COUNT(*) OVER () * 0.85::DOUBLE) AS BIGINT) AS cut FROM documents),
 s AS (SELECT doc_id, CASE WHEN place < cut THEN 'train' ELSE 'test' END AS split,
              CASE WHEN place < cut THEN place ELSE place - cut END AS index FROM p)
"""


@model("rec_01_chat_record", SPLIT_SQL + """
SELECT doc_id, 'catalogue' AS data_source, 'system' AS first_role, 'user' AS second_role, d.text AS content,
       'sql' AS ability, 'rule' AS style, 0.0::DOUBLE AS ground_truth, s.split, s.index, d.source AS model_name
FROM s JOIN documents d USING (doc_id)
""")
def chat_records(t):
    split = rec.exact_split(t.documents.select("doc_id", "text", "source"), "doc_id")
    extra = {
        "split": F.col("split"), "index": F.col("index"), "model_name": F.col("source"),
        "expected_columns": F.array(F.lit("doc_id")), "unique_key": F.lit("doc_id"),
    }
    record = rec.chat_record(F.lit("Answer in SQL."), F.col("text"), "catalogue", "sql", extra)
    rows = split.select("doc_id", *record)
    return rows.select(
        "doc_id", "data_source", F.col("prompt")[0]["role"].alias("first_role"),
        F.col("prompt")[1]["role"].alias("second_role"), F.col("prompt")[1]["content"].alias("content"),
        "ability", "reward_model.style", "reward_model.ground_truth",
        "extra_info.split", "extra_info.index", "extra_info.model_name",
    )


@model("rec_01_prepared_splits", """
WITH p AS (SELECT *, ROW_NUMBER() OVER (ORDER BY md5('42:' || 'model_' || doc_id), 'model_' || doc_id) - 1 AS place,
                  CAST(TRUNC(COUNT(*) OVER () * 0.85::DOUBLE) AS BIGINT) AS cut FROM documents)
SELECT 'model_' || doc_id AS model_name, CASE WHEN place < cut THEN 'train' ELSE 'test' END AS split,
       CASE WHEN place < cut THEN place ELSE place - cut END AS index, text AS content, n_chars AS expected_row_count FROM p
""")
def prepared_splits(t):
    """Checked specs, split, built into records, stored and read back."""
    specs = t.documents.select(
        F.col("text").alias("prompt"),
        F.concat(F.lit("model_"), F.col("doc_id").cast("string")).alias("model_name"),
        F.array("lang").alias("expected_columns"), F.col("n_chars").alias("expected_row_count"),
        F.lit("doc_id").alias("unique_key"),
    )
    stored = rec.prepare_splits(
        specs, scratch_path(t.spark, "records"), "Answer in SQL.", "catalogue", "sql",
        {"specs": (n_rows(), 100)},
    )
    return stored.select(
        "extra_info.model_name", "split", "extra_info.index",
        F.col("prompt")[1]["content"].alias("content"), "extra_info.expected_row_count",
    )


@model("rec_02_exact_split", SPLIT_SQL + "SELECT * FROM s")
def exact_split(t):
    return rec.exact_split(t.documents.select("doc_id"), "doc_id")


# --- score comparison -------------------------------------------------------

SCORES_SQL = """
WITH scores AS (SELECT l_returnflag AS model, CASE l_linestatus WHEN 'F' THEN 'permissive' ELSE 'strict' END AS scorer,
   l_partkey AS item, CASE WHEN COUNT(*) = 1 THEN -1.0::DOUBLE
     ELSE CAST(SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) / 10.0 END AS score,
   MAX(l_tax) > 0.02 AS compile_ok, MAX(l_tax) > 0.04 AS run_ok FROM lineitem GROUP BY 1, 2, 3)
"""


def scores(t):
    """Parts are items, return flags models, line states scorers."""
    scorer = F.when(F.col("l_linestatus") == "F", "permissive").otherwise("strict")
    points = F.sum(to_minor("l_discount")).cast("double")
    return t.lineitem.groupBy(
        F.col("l_returnflag").alias("model"), scorer.alias("scorer"), F.col("l_partkey").alias("item")
    ).agg(
        F.when(n_rows() == 1, evals.FAILED).otherwise(points / n_rows() / 10.0).alias("score"),
        (F.max("l_tax") > 0.02).alias("compile_ok"),
        (F.max("l_tax") > 0.04).alias("run_ok"),
    )


SCORERS = ["permissive", "strict"]


@model("evl_01_side_by_side", SCORES_SQL + """
SELECT model, item, MAX(score) FILTER (scorer = 'permissive') AS permissive_score,
       bool_or(run_ok) FILTER (scorer = 'permissive') AS permissive_run_ok,
       MAX(score) FILTER (scorer = 'strict') AS strict_score,
       bool_or(run_ok) FILTER (scorer = 'strict') AS strict_run_ok
FROM scores GROUP BY 1, 2
""")
def side_by_side(t):
    return evals.side_by_side(scores(t), SCORERS, ["score", "run_ok"])


@model("evl_02_mean_scores", SCORES_SQL + """
SELECT model, scorer, ROUND(AVG(score) FILTER (score >= 0), 8) AS mean_score,
       COUNT(*) FILTER (score >= 0) AS scored, COUNT(*) FILTER (score < 0) AS failed FROM scores GROUP BY 1, 2
""")
def mean_scores(t):
    return evals.mean_scores(scores(t)).withColumn("mean_score", F.round("mean_score", 8))


WIDE = SCORES_SQL + """, w AS (SELECT model, item, MAX(score) FILTER (scorer = 'permissive') AS a,
  MAX(score) FILTER (scorer = 'strict') AS b FROM scores GROUP BY 1, 2)
"""


@model("evl_03_divergence", WIDE + """
SELECT model, COUNT(*) FILTER (a >= 0 AND b >= 0 AND ABS(a - b) > 0.1) AS divergent_items, COUNT(*) AS items
FROM w GROUP BY 1
""")
def divergent(t):
    return evals.divergence(scores(t), *SCORERS)


@model("evl_04_matrix", SCORES_SQL + "SELECT item, " + ", ".join(
    f"MAX(score) FILTER (model = '{m}' AND scorer = '{s}') AS {m.lower()}_{s}"
    for m in "ANR" for s in SCORERS
) + " FROM scores GROUP BY 1")
def matrix(t):
    wide = evals.matrix(scores(t), ["A", "N", "R"], SCORERS)
    return wide.withColumnsRenamed({c: c.lower() for c in wide.columns})


@model("evl_05_pass_counts", SCORES_SQL + """
SELECT model, scorer, COUNT(*) AS items, COUNT(*) FILTER (compile_ok) AS compile_ok_count,
       COUNT(*) FILTER (run_ok) AS run_ok_count,
       (CAST(COUNT(*) FILTER (compile_ok) AS DOUBLE) / COUNT(*)) AS compile_ok_share,
       (CAST(COUNT(*) FILTER (run_ok) AS DOUBLE) / COUNT(*)) AS run_ok_share
FROM scores GROUP BY 1, 2
""")
def pass_counts(t):
    return evals.pass_counts(scores(t), ["compile_ok", "run_ok"])


@model("evl_06_relative_delta", SCORES_SQL + """, m AS (SELECT model, scorer, AVG(score) FILTER (score >= 0) AS mean FROM scores GROUP BY 1, 2)
SELECT a.scorer, ROUND(a.mean, 8) AS base_mean, ROUND(r.mean, 8) AS other_mean,
       ROUND((r.mean - a.mean) / NULLIF(a.mean, 0), 6) AS relative_delta
FROM m a JOIN m r ON a.scorer = r.scorer AND a.model = 'A' AND r.model = 'R'
""")
def relative_delta(t):
    delta = evals.relative_delta(evals.mean_scores(scores(t)), "A", "R")
    return delta.withColumns({c: F.round(c, 8) for c in ("base_mean", "other_mean")})
