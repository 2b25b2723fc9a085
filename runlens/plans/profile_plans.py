"""Registered queries for dataset profiling and standardization (2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import standardize as S
from ..session import scratch_path
from ..sources import io as IO
from .registry import query

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

# datasets profiled together: name -> (fixture view, DuckDB source, key, [(column, kind, spark dtype)])
QA_SQL = "SELECT doc_id AS metadata_id, text AS question, lang AS answer, source AS context FROM documents"
DATASETS = {
    "mcq": ("mcq_v", "mcq_v", "id", [("id", "num", "bigint"), ("story", "str", "string"), ("question", "str", "string"),
                                     ("candidate_answers", "arr", "array<string>"), ("answer", "num", "int")]),
    "code": ("code_v", "code_v", "id", [("id", "num", "bigint"), ("content", "str", "string"), ("python", "str", "string"),
                                        ("difficulty", "str", "string")]),
    "qa": (None, f"({QA_SQL})", "metadata_id", [("metadata_id", "num", "bigint"), ("question", "str", "string"),
                                                ("answer", "str", "string"), ("context", "str", "string")]),
    "bench": (None, "benchmark", "item_id", [("item_id", "num", "bigint"), ("text", "str", "string")]),
    "labels": (None, "labels", "doc_id", [("doc_id", "num", "bigint"), ("quality", "num", "int"), ("toxic", "num", "int")]),
}
VIEWS = ["mcq_v", "code_v"]


def _spark_dataset(fx, name):
    if name == "mcq":
        return fx.mcq_v
    if name == "code":
        return fx.code_v
    if name == "qa":
        return fx.documents.select(F.col("doc_id").alias("metadata_id"), F.col("text").alias("question"),
                                   F.col("lang").alias("answer"), F.col("source").alias("context"))
    if name == "bench":
        return fx.benchmark
    return fx.labels


def spark_profile(fx):
    return P.profile_datasets({name: (_spark_dataset(fx, name), key) for name, (_, _, key, _) in DATASETS.items()})


def _vstr(col: str, kind: str) -> str:
    if kind == "arr":
        return f"'[' || array_to_string(list_transform({col}, lambda v: '''' || v || ''''), ', ') || ']'"
    if kind == "num":
        return f"CAST({col} AS VARCHAR)"
    return col


def _profile_sql() -> str:
    parts = []
    for name, (_, src, key, cols) in DATASETS.items():
        longs = " UNION ALL ".join(
            f"SELECT {key} AS _k, '{c}' AS col, {i} AS position, {'TRUE' if k == 'num' else 'FALSE'} AS nn, "
            f"{_vstr(c, k)} AS v FROM {src}"
            for i, (c, k, _) in enumerate(cols)
        )
        meta = ", ".join(f"('{c}', {i}, '{t}')" for i, (c, _, t) in enumerate(cols))
        prefixes = " OR ".join(f"starts_with({STRIP.format(x='v')}, '{p}')" for p in P.STRUCTURED_PREFIXES)
        bools = ", ".join(f"'{b}'" for b in P.BOOLEAN_VALUES)
        parts.append(f"""
SELECT '{name}' AS dataset_name, m.col AS "column", m.position, m.dtype,
  CASE WHEN coalesce(n, 0) = 0 THEN 'empty'
       WHEN avg_raw < 10 AND uq < coalesce(n, 0) * 0.5 THEN 'categorical'
       WHEN boo THEN 'boolean' WHEN num THEN 'numeric' ELSE 'text' END AS type,
  coalesce(round(avg_raw, 1), 0.0) AS avg_length, coalesce(avg_raw, 0.0) AS avg_length_raw,
  coalesce(uq, 0) AS unique_values, coalesce(n, 0) AS n_values, coalesce(sc, 0) AS structured_count,
  coalesce(samples, CAST([] AS VARCHAR[])) AS sample_values
FROM (VALUES {meta}) m(col, position, dtype)
LEFT JOIN (
  SELECT col, count(*) AS n, avg(length(v)) AS avg_raw, count(DISTINCT lower(v)) AS uq,
         bool_and(nn OR TRY_CAST(v AS DOUBLE) IS NOT NULL) AS num, bool_and(lower(v) IN ({bools})) AS boo,
         CAST(sum(CASE WHEN {prefixes} THEN 1 ELSE 0 END) AS BIGINT) AS sc,
         list(v ORDER BY r) FILTER (WHERE r <= 3) AS samples
  FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY _k) AS r
        FROM ({longs}) WHERE v IS NOT NULL)
  GROUP BY col) g ON g.col = m.col""")
    return "prof AS (" + "\nUNION ALL\n".join(parts) + "\n)"


PROFILE_CTE = _profile_sql()

PATTERNS_SQL = ", ".join(
    [f"('input', {i}, '{p}')" for i, p in enumerate(P.INPUT_PATTERNS)]
    + [f"('output', {i}, '{p}')" for i, p in enumerate(P.OUTPUT_PATTERNS)]
)
BOOST = ", ".join(f"'{p}'" for p in P.BOOST_PATTERNS)
FULLW = " OR ".join(f"contains(lower(\"column\"), '{w}')" for w in P.COMPLETE_WORDS)
ORW = " OR ".join(f"contains(lower(\"column\"), '{w}')" for w in P.ORACLE_WORDS)

ROLES_CTE = PROFILE_CTE + f""",
pm AS (SELECT * FROM (VALUES {PATTERNS_SQL}) t(kind, pattern_order, pattern)),
fp AS (SELECT dataset_name, "column", kind, arg_min(pattern, pattern_order) AS pattern
       FROM prof CROSS JOIN pm WHERE contains(lower("column"), pattern) GROUP BY 1, 2, 3),
roles AS (
  SELECT fp.dataset_name, fp."column", prof.position, fp.kind, fp.pattern,
    CAST(least(1.0, CASE WHEN lower(fp."column") = fp.pattern THEN 1.0 ELSE 0.8 END
      + CASE WHEN fp.pattern IN ({BOOST}) AND prof.n_values > 0 THEN least(0.2,
          CASE WHEN prof.avg_length_raw > 20 THEN 0.1 ELSE 0.0 END
          + CASE WHEN prof.structured_count > prof.n_values * 0.5 THEN 0.1 ELSE 0.0 END) ELSE 0.0 END) AS DOUBLE) AS confidence,
    CASE WHEN {FULLW.replace('"column"', 'fp."column"')} THEN 0.3 ELSE 0.0 END
      + CASE WHEN {ORW.replace('"column"', 'fp."column"')} THEN 0.2 ELSE 0.0 END
      + least(0.2, length(fp."column") / 50.0) AS completeness
  FROM fp JOIN prof ON fp.dataset_name = prof.dataset_name AND fp."column" = prof."column")
"""

SETS_SQL = ", ".join(
    f"('{name}', {si}, '{field}', {fi}, {len(fields)})"
    for si, (name, fields) in enumerate(P.FIELD_SETS) for fi, field in enumerate(fields)
)

SETS_CTE = ROLES_CTE + f""",
st AS (SELECT * FROM (VALUES {SETS_SQL}) t(set_name, set_order, field, field_order, needed)),
pf AS (SELECT dataset_name, set_name, set_order, needed, field, field_order, arg_min("column", position) AS c
       FROM prof CROSS JOIN st WHERE contains(lower("column"), lower(field)) GROUP BY ALL),
sets AS (SELECT dataset_name, set_name, set_order, list(c ORDER BY field_order) AS columns
         FROM pf GROUP BY dataset_name, set_name, set_order, needed HAVING count(*) = needed)
"""

RECO_CTE = SETS_CTE + """,
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY len(columns) DESC, set_order) AS r
                      FROM sets) WHERE r = 1),
tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name, kind
                                                   ORDER BY confidence DESC, completeness DESC, position) AS r
                      FROM roles) WHERE r = 1),
ds AS (SELECT DISTINCT dataset_name FROM prof),
reco AS (
  SELECT ds.dataset_name,
    CASE WHEN bs.columns IS NOT NULL THEN 'multi_field' WHEN i."column" IS NOT NULL AND o."column" IS NOT NULL
         THEN 'single_field' ELSE 'unknown' END AS type,
    CASE WHEN bs.columns IS NOT NULL THEN bs.set_name END AS pattern_name,
    CASE WHEN bs.columns IS NOT NULL THEN bs.columns[1:len(bs.columns) - 1]
         WHEN i."column" IS NOT NULL AND o."column" IS NOT NULL THEN list_value(i."column")
         ELSE CAST([] AS VARCHAR[]) END AS input_fields,
    CASE WHEN bs.columns IS NOT NULL THEN bs.columns[-1]
         WHEN i."column" IS NOT NULL AND o."column" IS NOT NULL THEN o."column" END AS output_field,
    CASE WHEN bs.columns IS NOT NULL THEN 0.8
         WHEN i."column" IS NOT NULL AND o."column" IS NOT NULL THEN (i.confidence + o.confidence) / 2 ELSE 0.0 END AS confidence
  FROM ds LEFT JOIN bs ON bs.dataset_name = ds.dataset_name
  LEFT JOIN (SELECT * FROM tr WHERE kind = 'input') i ON i.dataset_name = ds.dataset_name
  LEFT JOIN (SELECT * FROM tr WHERE kind = 'output') o ON o.dataset_name = ds.dataset_name)
"""


@query("profile_columns", VIEWS, section="2.12", oracle="WITH " + PROFILE_CTE + "\nSELECT * FROM prof")
def _q(fx):
    return spark_profile(fx)


@query("detect_roles", VIEWS, section="2.12", oracle="WITH " + ROLES_CTE + "\nSELECT * FROM roles")
def _q(fx):
    return P.detect_roles(spark_profile(fx))


@query("content_boost", VIEWS, section="2.12", oracle="WITH " + ROLES_CTE + f"""
SELECT prof.dataset_name, prof."column", roles.pattern,
  CAST(CASE WHEN roles.pattern IN ({BOOST}) AND n_values > 0 THEN least(0.2,
    CASE WHEN avg_length_raw > 20 THEN 0.1 ELSE 0.0 END
    + CASE WHEN structured_count > n_values * 0.5 THEN 0.1 ELSE 0.0 END) ELSE 0.0 END AS DOUBLE) AS boost
FROM prof JOIN roles ON prof.dataset_name = roles.dataset_name AND prof."column" = roles."column"
WHERE roles.kind = 'output'
""")
def _q(fx):
    prof = spark_profile(fx)
    out = prof.select("*", P.first_pattern(F.col("column"), P.OUTPUT_PATTERNS).alias("pattern"))
    out = out.filter(F.col("pattern").isNotNull())
    return out.select("dataset_name", "column", "pattern", P.content_boost(F.col("pattern")).alias("boost"))


@query("detect_field_sets", VIEWS, section="2.12", oracle="WITH " + SETS_CTE + "\nSELECT * FROM sets")
def _q(fx):
    return P.detect_field_sets(spark_profile(fx))


@query("recommend_mapping", VIEWS, section="2.12", oracle="WITH " + RECO_CTE + "\nSELECT * FROM reco")
def _q(fx):
    return P.recommend_mapping(spark_profile(fx))


def _labels_list(m):
    return F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


RULES_SQL = RECO_CTE + """,
cols AS (SELECT dataset_name, list("column") AS columns FROM prof GROUP BY 1),
rj AS (SELECT reco.*, cols.columns,
  list_contains(cols.columns, 'content') AND (list_contains(cols.columns, 'java') OR list_contains(cols.columns, 'c++')
    OR list_contains(cols.columns, 'python') OR list_contains(cols.columns, 'javascript')) AS coding
  FROM reco LEFT JOIN cols ON reco.dataset_name = cols.dataset_name),
rr AS (SELECT *, coding AND list_contains(columns, 'python') AS coding_ok FROM rj),
rules AS (
  SELECT dataset_name,
    CASE WHEN coding_ok THEN 'coding_dataset' ELSE coalesce(type, 'manual') END AS transformation_type,
    CASE WHEN coding_ok THEN 1.0 ELSE coalesce(confidence, 0.0) END AS confidence,
    CASE WHEN type = 'multi_field' THEN 'multi_field' ELSE 'single_field' END AS input_format,
    CASE WHEN coding_ok THEN list_value('content') ELSE input_fields END AS input_fields,
    CASE WHEN coding_ok THEN 'python' ELSE output_field END AS output_field, chr(10) || chr(10) AS field_separator,
    CASE WHEN type = 'multi_field' AND pattern_name = 'story_question_choices'
           THEN list_value('candidate_answers=OPTIONS:', 'question=QUESTION:', 'story=STORY:')
         WHEN type = 'multi_field' AND pattern_name = 'context_question'
           THEN list_transform(list_filter(list_zip((CASE WHEN coding_ok THEN list_value('content') ELSE input_fields END)[1:2],
                                        list_value('CONTEXT:', 'QUESTION:')), lambda z: z[1] IS NOT NULL), lambda z: z[1] || '=' || z[2])
         WHEN type = 'multi_field' AND pattern_name = 'sentence_pair'
           THEN list_transform(list_filter(list_zip((CASE WHEN coding_ok THEN list_value('content') ELSE input_fields END)[1:2],
                                        list_value('SENTENCE 1:', 'SENTENCE 2:')), lambda z: z[1] IS NOT NULL), lambda z: z[1] || '=' || z[2])
         WHEN type = 'multi_field'
           THEN list_sort(list_transform(CASE WHEN coding_ok THEN list_value('content') ELSE input_fields END,
                                         lambda f: f || '=' || upper(replace(f, '_', ' ')) || ':'))
         ELSE CAST([] AS VARCHAR[]) END AS field_labels,
    CASE WHEN coding_ok THEN list_value('extract_code_only')
         WHEN type = 'multi_field' AND pattern_name = 'story_question_choices' THEN list_value('resolve_answer_index')
         ELSE CAST([] AS VARCHAR[]) END || list_value('filter_by_difficulty') AS preprocessing_steps,
    CASE WHEN coding_ok THEN 'python' END AS language, 'hard' AS difficulty_filter
  FROM rr)
"""


@query("make_rules", VIEWS, section="2.12", oracle="WITH " + RULES_SQL + "\nSELECT * FROM rules")
def _q(fx):
    prof = spark_profile(fx)
    r = S.make_rules(P.recommend_mapping(prof), prof, language="python", difficulty="HARD")
    return r.withColumn("field_labels", _labels_list(F.col("field_labels")))


@query("override_rules", VIEWS, section="2.12", oracle="WITH " + RULES_SQL + """,
ov AS (SELECT * FROM (VALUES ('qa', list_value('context', 'question'), 'answer', CAST([] AS VARCHAR[])),
                             ('bench', list_value('text'), 'missing_col', CAST([] AS VARCHAR[])),
                             ('mcq', list_value('story', 'question', 'candidate_answers'), 'answer',
                              list_value('resolve_answer_index')))
       t(dataset_name, o_in, o_out, o_steps)),
ok AS (SELECT ov.* FROM ov JOIN cols ON ov.dataset_name = cols.dataset_name
       WHERE list_has_all(cols.columns, ov.o_in) AND list_contains(cols.columns, ov.o_out))
SELECT rules.dataset_name, transformation_type,
  CASE WHEN ok.o_in IS NOT NULL THEN 1.0 ELSE confidence END AS confidence, input_format,
  coalesce(ok.o_in, input_fields) AS input_fields, CASE WHEN ok.o_in IS NOT NULL THEN ok.o_out ELSE output_field END AS output_field,
  field_separator,
  CASE WHEN ok.o_in IS NULL THEN field_labels
       WHEN len(list_distinct(ok.o_in)) = 3 AND list_has_all(list_value('story', 'question', 'candidate_answers'), ok.o_in)
         THEN list_value('candidate_answers=OPTIONS:', 'question=QUESTION:', 'story=STORY:')
       WHEN list_contains(ok.o_in, 'context') AND list_contains(ok.o_in, 'question')
         THEN list_sort(list_value(ok.o_in[1] || '=' || CASE WHEN contains(ok.o_in[1], 'context') THEN 'CONTEXT:' ELSE 'INPUT:' END,
                                   ok.o_in[2] || '=' || CASE WHEN contains(ok.o_in[2], 'question') THEN 'QUESTION:' ELSE 'QUERY:' END))
       ELSE list_sort(list_transform(ok.o_in, lambda f: f || '=' || upper(f) || ':')) END AS field_labels,
  CASE WHEN ok.o_in IS NOT NULL THEN ok.o_steps ELSE preprocessing_steps END AS preprocessing_steps,
  language, difficulty_filter, ok.o_in IS NOT NULL AS manually_corrected
FROM rules LEFT JOIN ok ON rules.dataset_name = ok.dataset_name
""")
def _q(fx):
    prof = spark_profile(fx)
    rules = S.make_rules(P.recommend_mapping(prof), prof, language="python", difficulty="HARD")
    ov = fx.spark.createDataFrame(
        [("qa", ["context", "question"], "answer", []),
         ("bench", ["text"], "missing_col", []),
         ("mcq", ["story", "question", "candidate_answers"], "answer", ["resolve_answer_index"])],
        "dataset_name string, input_fields array<string>, output_field string, preprocessing_steps array<string>",
    )
    out, _rejected = S.override_rules(rules, ov, prof)
    return out.withColumn("field_labels", _labels_list(F.col("field_labels")))


@query("to_io_single", [], section="2.12", oracle=f"""
SELECT metadata_id, question AS "INPUT", answer AS "OUTPUT", '' AS missing FROM {DATASETS['qa'][1]}
""")
def _q(fx):
    qa = _spark_dataset(fx, "qa")
    return qa.select("metadata_id", S.to_io_single(qa, "question").alias("INPUT"),
                     S.to_io_single(qa, "answer").alias("OUTPUT"), S.to_io_single(qa, "nope").alias("missing"))


FORMAT_OPTS = ("coalesce(array_to_string(list_transform({a}, lambda x, i: chr(CAST(64 + i AS INTEGER)) || ') ' || "
               + STRIP.format(x="x") + "), chr(10)), '')")
MULTI_SQL = ("concat('STORY:', chr(10), chr(10), coalesce(story, 'None'), chr(10), chr(10), chr(10), chr(10), "
             "'QUESTION:', chr(10), chr(10), coalesce(question, 'None'), chr(10), chr(10), chr(10), chr(10), "
             "'OPTIONS:', chr(10), chr(10), " + FORMAT_OPTS.format(a="candidate_answers") + ")")


@query("to_io_multi", ["mcq_v"], section="2.12", oracle=f"SELECT id, {MULTI_SQL} AS \"INPUT\" FROM mcq_v")
def _q(fx):
    m = fx.mcq_v
    return m.select("id", S.to_io_multi(m, ["story", "question", "candidate_answers", "absent_field"],
                                        S.STORY_LABELS).alias("INPUT"))


@query("format_options", ["mcq_v"], section="2.12", oracle=f"""
SELECT id, {FORMAT_OPTS.format(a='candidate_answers')} AS options3,
       {FORMAT_OPTS.format(a="list_transform(range(1, 31), lambda i: story || '-' || CAST(i AS VARCHAR))")} AS options30,
       {FORMAT_OPTS.format(a='CAST([] AS VARCHAR[])')} AS options0
FROM mcq_v
""")
def _q(fx):
    m = fx.mcq_v
    thirty = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.col("story"), F.lit("-"), i.cast("string")))
    return m.select("id", S.format_options("candidate_answers").alias("options3"),
                    S.format_options(thirty).alias("options30"),
                    S.format_options(F.array().cast("array<string>")).alias("options0"))


@query("resolve_answer_index", ["mcq_v"], section="2.12", oracle=f"""
SELECT id, answer, CASE WHEN answer >= 0 AND answer < len(candidate_answers)
                        THEN {STRIP.format(x='candidate_answers[answer + 1]')} ELSE CAST(answer AS VARCHAR) END AS "OUTPUT"
FROM mcq_v
""")
def _q(fx):
    m = fx.mcq_v
    return m.select("id", "answer", S.resolve_answer_index(m, "answer").alias("OUTPUT"))


@query("extract_code", ["code_v"], section="2.12", oracle=f"""
SELECT id,
  CASE WHEN regexp_matches(python, '(?s)```python\\s*\\n(.*?)\\n```')
       THEN {STRIP.format(x="regexp_extract(python, '(?s)```python\\s*\\n(.*?)\\n```', 1)")} ELSE python END AS code_python,
  python AS code_unknown
FROM code_v
""")
def _q(fx):
    c = fx.code_v
    return c.select("id", S.extract_code("python", "python").alias("code_python"),
                    S.extract_code("python", "cobol").alias("code_unknown"))


MCQ_IO_SQL = f"""
WITH io AS (SELECT id, {MULTI_SQL} AS "INPUT",
  CASE WHEN answer >= 0 AND answer < len(candidate_answers)
       THEN {STRIP.format(x='candidate_answers[answer + 1]')} ELSE CAST(answer AS VARCHAR) END AS "OUTPUT" FROM mcq_v)
"""


def _mcq_io(fx, keep=()):
    m = fx.mcq_v
    rules = {"input_format": "multi_field", "input_fields": ["story", "question", "candidate_answers"],
             "output_field": "answer", "field_labels": S.STORY_LABELS, "preprocessing_steps": ["resolve_answer_index"],
             "field_separator": "\n\n"}
    return S.apply_rules(m, rules, keep)


@query("validate_io", ["mcq_v"], section="2.12", oracle=MCQ_IO_SQL + f"""
, t AS (SELECT count(*) AS n,
               CAST(sum(CASE WHEN {STRIP.format(x='coalesce("INPUT", \'\')')} = '' THEN 1 ELSE 0 END) AS BIGINT) AS ei,
               CAST(sum(CASE WHEN {STRIP.format(x='coalesce("OUTPUT", \'\')')} = '' THEN 1 ELSE 0 END) AS BIGINT) AS eo
        FROM io),
o AS (SELECT count(*) AS original_samples FROM mcq_v)
SELECT original_samples = n AS sample_count_preserved, original_samples, n AS transformed_samples,
  ei AS empty_inputs, eo AS empty_outputs, CASE WHEN n > 0 THEN (ei + eo) / (2.0 * n) ELSE 0.0 END AS empty_ratio,
  original_samples = n AND coalesce((ei + eo) / (2.0 * nullif(n, 0)) <= 0.1, TRUE) AS validation_passed,
  list_filter(list_value(
    CASE WHEN original_samples <> n THEN 'Sample count changed: ' || original_samples || ' -> ' || n END,
    CASE WHEN ei > 0 THEN ei || ' samples have empty INPUT fields' END,
    CASE WHEN eo > 0 THEN eo || ' samples have empty OUTPUT fields' END,
    CASE WHEN (ei + eo) / (2.0 * nullif(n, 0)) > 0.1 THEN 'Too many empty fields' END), lambda x: x IS NOT NULL) AS issues
FROM o CROSS JOIN t
""")
def _q(fx):
    return S.validate_io(fx.mcq_v, _mcq_io(fx))


@query("validate_format", ["mcq_v"], section="2.12", oracle=MCQ_IO_SQL + """
SELECT 'mcq' AS name, list_filter(list_value(
    CASE WHEN count(*) = 0 THEN 'File is empty' END,
    CASE WHEN count(*) > 0 AND count("INPUT") = 0 THEN 'INPUT column is empty' END,
    CASE WHEN count(*) > 0 AND count("OUTPUT") = 0 THEN 'OUTPUT column is empty' END,
    CASE WHEN coalesce(arg_min("INPUT", id), '') = '' THEN 'INPUT column contains empty values' END,
    CASE WHEN coalesce(arg_min("OUTPUT", id), '') = '' THEN 'OUTPUT column contains empty values' END),
    lambda x: x IS NOT NULL) AS errors, count(*) AS num_rows, TRUE AS has_input, TRUE AS has_output FROM io
UNION ALL
SELECT 'bench', list_value('Missing required ''INPUT'' column', 'Missing required ''OUTPUT'' column'),
       count(*), FALSE, FALSE FROM benchmark
""")
def _q(fx):
    a = S.validate_format(_mcq_io(fx, keep=("id",)), key="id").withColumn("name", F.lit("mcq"))
    b = S.validate_format(fx.benchmark).withColumn("name", F.lit("bench"))
    return a.unionByName(b).drop("is_valid")


@query("validate_export", ["mcq_v"], section="2.12", oracle=MCQ_IO_SQL + """
SELECT 'parquet' AS format, count(*) AS num_rows, TRUE AS has_input_output, TRUE AS is_valid,
       CAST([] AS VARCHAR[]) AS errors, CAST([] AS VARCHAR[]) AS warnings FROM io
""")
def _q(fx):
    path = f"{scratch_path(fx.spark, 'export')}/mcq.parquet"
    IO.write_standardized(_mcq_io(fx), path)
    return IO.validate_export_file(fx.spark, path)


def _blank(x: str) -> str:
    inner = STRIP.format(x=f"coalesce({x}, '')")
    return f"CAST(sum(CASE WHEN {inner} = '' THEN 1 ELSE 0 END) AS BIGINT)"


STD_BATCH_SQL = "WITH " + RECO_CTE + f""",
cols AS (SELECT dataset_name, list("column") AS columns FROM prof GROUP BY 1),
conf AS (
  SELECT reco.dataset_name,
    CASE WHEN list_contains(columns, 'content') AND (list_contains(columns, 'java') OR list_contains(columns, 'c++')
              OR list_contains(columns, 'python') OR list_contains(columns, 'javascript'))
         THEN 0.0 ELSE reco.confidence END AS confidence
  FROM reco JOIN cols ON reco.dataset_name = cols.dataset_name),
io AS (
  SELECT 'mcq' AS dataset_name,
         concat('STORY:', chr(10), chr(10), coalesce(story, 'None'), chr(10), chr(10), chr(10), chr(10),
                'QUESTION:', chr(10), chr(10), coalesce(question, 'None')) AS i,
         coalesce({_vstr('candidate_answers', 'arr')}, 'None') AS o
  FROM mcq_v
  UNION ALL
  SELECT 'qa', concat('CONTEXT:', chr(10), chr(10), coalesce(source, 'None')), coalesce(text, 'None') FROM documents),
v AS (SELECT dataset_name, count(*) AS n, {_blank('i')} AS ei, {_blank('o')} AS eo FROM io GROUP BY 1),
orig AS (SELECT 'mcq' AS dataset_name, count(*) AS original_samples FROM mcq_v
         UNION ALL SELECT 'qa', count(*) FROM documents),
r AS (
  SELECT conf.dataset_name, conf.confidence, orig.original_samples, v.n, v.ei, v.eo,
         orig.original_samples = v.n AND coalesce((v.ei + v.eo) / (2.0 * nullif(v.n, 0)) <= 0.1, TRUE) AS passed,
         list_filter(list_value(
           CASE WHEN orig.original_samples <> v.n THEN 'Sample count changed: ' || orig.original_samples || ' -> ' || v.n END,
           CASE WHEN v.ei > 0 THEN v.ei || ' samples have empty INPUT fields' END,
           CASE WHEN v.eo > 0 THEN v.eo || ' samples have empty OUTPUT fields' END,
           CASE WHEN (v.ei + v.eo) / (2.0 * nullif(v.n, 0)) > 0.1 THEN 'Too many empty fields' END),
           lambda x: x IS NOT NULL) AS issues
  FROM conf LEFT JOIN v ON conf.dataset_name = v.dataset_name LEFT JOIN orig ON conf.dataset_name = orig.dataset_name)
SELECT dataset_name,
  CASE WHEN confidence < 0.6 THEN 'skipped' WHEN passed THEN 'processed' ELSE 'failed' END AS status,
  confidence,
  CASE WHEN confidence >= 0.6 THEN original_samples END AS original_samples,
  CASE WHEN confidence >= 0.6 THEN n END AS processed_samples,
  CASE WHEN confidence >= 0.6 THEN passed END AS validation_passed,
  CASE WHEN confidence < 0.6 THEN 'low confidence' ELSE nullif(array_to_string(issues, '; '), '') END AS error
FROM r
"""


@query("standardize_batch", VIEWS, section="2.12", oracle=STD_BATCH_SQL)
def _q(fx):
    ds = {name: (_spark_dataset(fx, name), key) for name, (_, _, key, _) in DATASETS.items()}
    return S.standardize_batch(ds)


@query("preprocessing_status", ["preprocessing_v"], section="2.12", oracle="""
SELECT * EXCLUDE (rk) FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_name, dataset_config ORDER BY processed_at DESC, id DESC) AS rk
  FROM preprocessing_v) WHERE rk = 1
""")
def _q(fx):
    return S.preprocessing_status(fx.preprocessing_v)


@query("list_preprocessed", ["preprocessing_v"], section="2.12", oracle="""
SELECT * FROM preprocessing_v WHERE status = 'processed' ORDER BY processed_at DESC, id
""")
def _q(fx):
    return S.list_preprocessed(fx.preprocessing_v, status="processed")
