"""Answers, messages and prompts as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences

#: Characters that texts are cut to, by use.
CUTS = {"claim": 100, "detail": 150, "caption": 300, "evidence": 500, "judge": 1500, "context": 2000}


def cut(text: Column, use: str) -> Column:
    """C24."""
    return F.left(text, F.lit(CUTS[use]))


def sentence_spans(text: Column) -> Column:
    """(start, end) of each sentence, half-open from 0, searched onwards from the end of the one before; -1 where it isn't found."""

    def add(acc, s):
        found = F.call_function("locate", s, text, acc["at"] + 1) - 1
        start = F.when(found >= 0, found).otherwise(F.lit(-1))
        end = F.when(found >= 0, found + F.length(s)).otherwise(F.lit(-1))
        return F.struct(F.when(found >= 0, end).otherwise(acc["at"]).alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(sentences(text), empty, add, lambda acc: acc["spans"])


def _steps(steps: Column, numbered: bool) -> Column:
    line = lambda s: F.when(F.lit(numbered) & (F.coalesce(s["step"], F.lit("")) != ""), F.concat(F.lit("Step "), s["step"], F.lit(": "), F.coalesce(s["reasoning"], F.lit("")))).otherwise(F.coalesce(s["reasoning"], F.lit("")))
    return F.transform(F.coalesce(steps, F.array().cast("array<struct<step:string,reasoning:string>>")), line)


def answer_text(steps: Column, conclusion: Column, form: str) -> Column:
    """`reasoning_first` and `conclusion_first` join the reasonings and the conclusion by blanks; `blocks` has Thinking and Answer blocks.

    steps: array of (step, reasoning). Empty parts are left out."""
    end = F.coalesce(conclusion, F.lit(""))
    filled = lambda a: F.filter(a, lambda x: x != "")
    if form == "blocks":
        lines = _steps(steps, True)
        think = F.when(F.size(lines) > 0, F.concat(F.lit("Thinking:\n"), F.array_join(lines, "\n"))).otherwise("")
        return F.array_join(filled(F.array(think, F.when(end != "", F.concat(F.lit("Answer: "), end)).otherwise(""))), "\n\n")
    parts = _steps(steps, False)
    return F.array_join(filled(F.concat(parts, F.array(end)) if form == "reasoning_first" else F.concat(F.array(end), parts)), " ")


def parse_messages(messages: Column) -> Column:
    """C20: (question, evidence, answer) of messages: array of (role, text, is_list).

    Parts of a user's text list are split at blank lines and go by their prefix; captions and contexts add up as evidence. Without
    a question the whole text is it; a plain user text is the question. The first assistant's text is the answer."""
    user = F.filter(messages, lambda m: m["role"] == "user")
    after = lambda p, k: F.trim(F.substr(p, F.lit(len(k) + 1)))
    white = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")

    def add(acc, m):
        parts = F.split(F.coalesce(m["text"], F.lit("")), "\n\n")
        asked = F.filter(parts, lambda p: p.startswith("Question:"))
        told = F.transform(F.filter(parts, lambda p: p.startswith("Caption:") | p.startswith("Context:")), lambda p: F.when(p.startswith("Caption:"), after(p, "Caption:")).otherwise(after(p, "Context:")))
        question = F.when(F.size(asked) > 0, after(F.element_at(asked, -1), "Question:")).otherwise(acc["question"])
        question = F.when(~m["is_list"], F.coalesce(m["text"], F.lit(""))).when(question == "", F.coalesce(m["text"], F.lit(""))).otherwise(question)
        return F.struct(question.alias("question"), F.when(m["is_list"], F.concat(acc["evidence"], told)).otherwise(acc["evidence"]).alias("evidence"))

    empty = F.struct(F.lit("").alias("question"), F.array().cast("array<string>").alias("evidence"))
    both = F.aggregate(user, empty, add)
    answer = F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == "assistant"), 0)["text"], F.lit(""))
    return F.struct(white(both["question"]).alias("question"), white(F.array_join(both["evidence"], " ")).alias("evidence"), answer.alias("answer"))


def build_messages(question: Column, caption: Column, context: Column, images: Column, answer: Column, system: str) -> Column:
    """System, user (one part per image, then the text; the context is cut) and assistant, each (role, content: array of (type, value))."""
    part = lambda k, v: F.struct(F.lit(k).alias("type"), v.alias("value"))
    told = F.filter(F.array(F.concat(F.lit("Caption: "), F.nullif(caption, F.lit(""))), F.concat(F.lit("Context: "), cut(F.nullif(context, F.lit("")), "context")), F.concat(F.lit("Question: "), question)), lambda x: x.isNotNull())
    user = F.concat(F.transform(F.coalesce(images, F.array().cast("array<string>")), lambda i: part("image", i)), F.array(part("text", F.array_join(told, "\n\n"))))
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(said("system", F.array(part("text", F.lit(system)))), said("user", user), said("assistant", F.array(part("text", answer))))


def judge_prompt(claim: Column, evidence: Column, scale: int = 10) -> Column:
    """Asks for a score of a claim against its evidence, as JSON."""
    return F.concat(F.lit("Evidence:\n"), cut(F.coalesce(evidence, F.lit("")), "judge"), F.lit("\n\nStatement:\n"), cut(claim, "evidence"), F.lit(f'\n\nHow well does the evidence support the statement? Reply with JSON: {{"score": 0 to {scale}}}'))


def resolved(df: DataFrame, path: str, files: DataFrame, root: str) -> DataFrame:
    """Df with `full_path` (relative paths below root) and `exists`, by a listing files(path) of full paths."""
    p = F.col(path)
    full = F.when(p.startswith("/") | p.contains("://"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))
    listed = files.select(F.col("path").alias("full_path")).distinct().withColumn("_there", F.lit(True))
    return df.withColumn("full_path", full).join(listed, "full_path", "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")
