"""Readers of nested conversation files, and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TURN = "array<struct<speaker:string,dia_id:string,text:string>>"
_QA = "array<struct<question:string,answer:string,evidence:array<string>,category:int>>"


def sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of a file of samples whose conversation has fields session_1, session_2 and so on.

    turns: sample_id, session, date, position, speaker, dia_id, text in order of session number and position.
    questions: sample_id, number, question, answer, category; those without an answer are left out.
    """
    raw = spark.read.option("multiLine", True).schema(f"sample_id string, qa {_QA}, conversation map<string,variant>").json(path)
    field = raw.select("sample_id", F.explode("conversation").alias("name", "value"))
    number = F.regexp_extract("name", r"^session_(\d+)$", 1)
    listed = field.filter(number != "").select("sample_id", number.cast("int").alias("session"), F.posexplode(F.expr(f"try_variant_get(value, '$', '{_TURN}')")).alias("position", "turn"))
    dates = field.filter(F.col("name").rlike(r"^session_\d+_date_time$")).select("sample_id", F.regexp_extract("name", r"(\d+)", 1).cast("int").alias("session"), F.expr("try_variant_get(value, '$', 'string')").alias("date"))
    turns = listed.join(dates, ["sample_id", "session"], "left").select("sample_id", "session", "date", "position", "turn.*")
    asked = raw.select("sample_id", F.posexplode("qa").alias("number", "q")).select("sample_id", "number", "q.question", "q.answer", "q.category").filter("answer IS NOT NULL")
    return turns, asked


def haystacks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of a file of questions, each with its own list of sessions, their ids and dates."""
    schema = "question_id string, question_type string, question string, question_date string, answer string, answer_session_ids array<string>, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    listed = raw.select("question_id", "haystack_dates", "haystack_session_ids", F.posexplode("haystack_sessions").alias("session", "turns"))
    turns = listed.select("question_id", "session", F.get("haystack_session_ids", F.col("session")).alias("session_id"), F.get("haystack_dates", F.col("session")).alias("date"), F.posexplode("turns").alias("position", "turn"))
    return turns.select("question_id", "session", "session_id", "date", "position", "turn.role", "turn.content"), raw.select("question_id", "question_type", "question", "question_date", "answer", "answer_session_ids")


def as_memories(turns: DataFrame, user: Column, role: Column, content: Column) -> DataFrame:
    """Turns as event memories of their user: tagged by role, the user's own a little more important."""
    return turns.select(
        "*",
        F.concat(role, F.lit(": "), content).alias("memory"),
        F.array(F.concat(F.lit("role:"), role), F.lit("conversation")).alias("tags"),
        F.when(role == "user", 0.4).otherwise(0.3).alias("importance"),
        F.lit("event").alias("kind"),
        F.lit("benchmark").alias("agent"),
        user.cast("string").alias("user"),
    )


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def headers(text: Column) -> Column:
    """A map of the name: value lines of a request's head, names lower-cased."""
    head = F.filter(F.split(F.element_at(F.split(text, r"\r?\n\r?\n", 2), 1), r"\r?\n"), lambda line: F.contains(line, F.lit(":")))
    pairs = F.transform(head, lambda line: F.struct(F.lower(F.trim(F.substring_index(line, ":", 1))).alias("key"), F.trim(F.substring(line, F.length(F.substring_index(line, ":", 1)) + 2, F.length(line))).alias("value")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))
