"""Transcript text: message lines and tool-call events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MESSAGE = "struct<type:string,text:string,content:string,message:struct<content:string>>"
BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:map<string,string>,tool_use_id:string,is_error:boolean,content:string>>"
FLAT = "struct<type:string,name:string,id:string,tool_use_id:string,input:map<string,string>,is_error:boolean,content:string>"


def message_lines(raw: DataFrame) -> DataFrame:
    """session, at, line of raw transcript lines (session, at, value): JSON with blocks, text or content, or plain text."""
    rows = raw.where(F.length(F.trim("value")) > 0).withColumn("j", F.from_json("value", MESSAGE))
    blocks = F.from_json("j.message.content", BLOCKS)
    texts = F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull())
    parts = (
        F.when(F.size(texts) > 0, texts)
        .when(F.col("j.message.content").isNotNull() & blocks.isNull(), F.array("j.message.content"))
        .when(F.col("j.text").isNotNull(), F.array("j.text"))
        .when(F.col("j.content").isNotNull(), F.array("j.content"))
        .otherwise(F.array(F.trim("value")))
    )
    return rows.select("session", "at", F.posexplode(parts).alias("part", "line"))


def tool_calls(raw: DataFrame) -> DataFrame:
    """session, at, tool, args, success, error: calls with their results, by id or else the call before."""
    rows = raw.withColumn("f", F.from_json("value", FLAT)).withColumn("b", F.from_json(F.from_json("value", MESSAGE)["message"]["content"], BLOCKS))
    flat = rows.where("f.type IN ('tool_use', 'tool_result')").select("session", "at", F.lit(0).alias("part"), "f.*")
    nested = rows.where("b IS NOT NULL").select("session", "at", F.posexplode("b").alias("part", "x")).where("x.type IN ('tool_use', 'tool_result')")
    nested = nested.select("session", "at", "part", "x.type", "x.name", "x.id", "x.tool_use_id", "x.input", "x.is_error", "x.content")
    events = flat.select(*nested.columns).unionByName(nested).withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy("at", "part")))
    w = Window.partitionBy("session").orderBy("n")
    before = F.last(F.when(F.col("type") == "tool_use", F.col("n")), ignorenulls=True).over(w)
    events = events.withColumn("before", before)
    calls = events.where("type = 'tool_use'").select("session", "n", "name", "id", "input")
    results = events.where("type = 'tool_result'").select("session", "tool_use_id", "before", "is_error", "content")
    by_id = results.where("tool_use_id IS NOT NULL").select("session", F.col("tool_use_id").alias("id"), "is_error", "content").dropDuplicates(["session", "id"])
    by_place = results.where("tool_use_id IS NULL").select("session", F.col("before").alias("n"), F.col("is_error").alias("e2"), F.col("content").alias("c2")).dropDuplicates(["session", "n"])
    joined = calls.join(by_id, ["session", "id"], "left").join(by_place, ["session", "n"], "left")
    failed = F.coalesce("is_error", "e2", F.lit(False))
    return joined.select("session", F.col("n").alias("at"), F.col("name").alias("tool"), F.col("input").alias("args"), (~failed).alias("success"), F.when(failed, F.coalesce("content", "c2")).alias("error"))
