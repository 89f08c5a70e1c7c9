"""Schemas: the nested result file as read from JSON, and the flat sample table."""

from pyspark.sql import types as T

SCORES = T.ArrayType(T.DoubleType())
METRIC_MAP = T.MapType(T.StringType(), T.DoubleType())

# `targets` is a JSON list in multiple-choice and scoring samples but an object
# (target -> metrics) in generative ones; read as text it keeps either form and
# is parsed per query type.
RAW_SAMPLE = T.StructType(
    [
        T.StructField("input", T.StringType()),
        T.StructField("targets", T.StringType()),
        T.StructField("scores", SCORES),
        T.StructField("absolute_scores", SCORES),
        T.StructField("normalized_scores", SCORES),
        T.StructField("target_values", METRIC_MAP),
        T.StructField("correct", T.DoubleType()),
        T.StructField("output", T.StringType()),
        T.StructField("metrics", METRIC_MAP),
    ]
)
RAW_QUERY = T.StructType(
    [
        T.StructField("query_type", T.StringType()),
        T.StructField("function", T.StringType()),
        T.StructField("shots", T.IntegerType()),
        T.StructField("samples", T.ArrayType(RAW_SAMPLE)),
    ]
)
SCORE_RECORD = T.StructType(
    [
        T.StructField("number_of_shots", T.IntegerType()),
        T.StructField("preferred_score", T.StringType()),
        T.StructField("score_dict", METRIC_MAP),
        T.StructField("subtask_description", T.StringType()),
    ]
)
RAW_HEADER = [
    T.StructField("task", T.StructType([T.StructField("task_name", T.StringType())])),
    T.StructField(
        "model",
        T.StructType(
            [
                T.StructField("model_family", T.StringType()),
                T.StructField("model_name", T.StringType()),
                T.StructField("flop_matched_non_embedding_params", T.LongType()),
            ]
        ),
    ),
]
RAW_SCORES = T.StructField("scores", T.ArrayType(SCORE_RECORD))
RAW_FILE = T.StructType([*RAW_HEADER, T.StructField("queries", T.ArrayType(RAW_QUERY)), RAW_SCORES])
RAW_FILE_HEADER = T.StructType([*RAW_HEADER, RAW_SCORES])  # read without queries

TARGET_LIST = T.ArrayType(T.StringType())
TARGET_OBJECT = T.MapType(T.StringType(), METRIC_MAP)

QUERY_TYPES = ("multiple_choice", "generative", "scoring")
MULTIPLE_CHOICE = "multiple_choice"
GENERATIVE = "generative"
SCORING = "scoring"
PAIRED = "scoring_generative"

METRICS_PER_TASK = T.MapType(T.StringType(), METRIC_MAP)
