"""The current turn of a conversation, from its messages in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modlens.functions.text import content_hash, normalise, turn_fingerprint


def turns(messages: DataFrame) -> DataFrame:
    """conv_id, continuation, user_hash, instructions, fingerprint of messages (conv_id, turn, role, text).

    Assistant messages at the end are left out. If a tool's message is last then, the turn goes on and its user text is
    the run of user messages before it; else that at the end. A run's texts are joined by an empty line. Instructions
    (system messages) count once each, in their order; messages that are empty when normalised count for nothing.
    """
    m = messages.select("conv_id", "turn", F.when(F.col("role").isin("system", "developer"), "instruction").otherwise(F.col("role")).alias("role"), normalise(F.col("text")).alias("text")).where("text <> ''")
    ins = m.where("role = 'instruction'").select("conv_id", "turn", content_hash(F.lit("instruction"), F.col("text")).alias("hash"))
    ins = ins.groupBy("conv_id", "hash").agg(F.min("turn").alias("turn")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "hash"))), lambda s: s["hash"]).alias("instructions"))
    talk = m.where("role <> 'instruction'")
    w = Window.partitionBy("conv_id")
    last = F.max(F.when(F.col("role") != "assistant", F.col("turn"))).over(w)
    talk = talk.withColumn("last", last).where(F.col("turn") <= F.col("last"))
    tool = F.max(F.when(F.col("turn") == F.col("last"), F.col("role") == "tool")).over(w)
    user = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w)
    talk = talk.withColumn("continuation", tool).withColumn("end", user)
    stop = F.max(F.when((F.col("role") != "user") & (F.col("turn") < F.col("end")), F.col("turn"))).over(w)
    talk = talk.withColumn("stop", F.coalesce(stop, F.lit(-1)))
    run = (F.col("role") == "user") & (F.col("turn") > F.col("stop")) & (F.col("turn") <= F.col("end"))
    by = talk.groupBy("conv_id").agg(F.max("continuation").alias("continuation"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(run, F.struct("turn", "text")))), lambda s: s["text"]), "\n\n").alias("user_text"))
    all_ = m.select("conv_id").distinct().join(by.withColumnRenamed("conv_id", "c1"), F.col("conv_id") == F.col("c1"), "left").join(ins.withColumnRenamed("conv_id", "c2"), F.col("conv_id") == F.col("c2"), "left")
    hashed = F.when(F.coalesce("user_text", F.lit("")) != "", content_hash(F.lit("user"), F.col("user_text")))
    listed = F.coalesce("instructions", F.array().cast("array<string>"))
    return all_.select("conv_id", F.coalesce("continuation", F.lit(False)).alias("continuation"), F.coalesce(hashed, F.lit("")).alias("user_hash"), F.size(listed).cast("long").alias("instructions"), turn_fingerprint(listed, hashed).alias("fingerprint"))
