"""Calls of an external model as an operator over tables, and the stages that feed each other.

A call is known by the hash of its prompt. The calls table holds states: `inflight` before a call, then `done`, `failed`
where the service refused it, or `uncertain` where nobody knows whether it was taken. What is done is never called again,
what failed may be, and what is inflight or uncertain without an answer is never repeated without being told to.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prompts to replies, or to a frame of reply, finish_reason, status (`ok`, an http status or a transport error) and cost.
Model = Callable[[pd.Series], "pd.Series | pd.DataFrame"]
# What is tried again, and how long it waits, in seconds.
RETRIED = ("http_403", "http_429", "http_500", "http_502", "http_503", "http_504", "http_524", "connect_error", "remote_protocol_error", "ssl_eof", "read_timeout")
BACKOFF = (10.0, 30.0, 60.0)
MODELS: dict[str, Model] = {}
CALLS = "prompt_sha string, stage string, state string, reply string, finish_reason string, cost double"


def register_model(name: str, model: Model) -> None:
    """model: a series of prompts to a series of replies."""
    MODELS[name] = model


def marker_model(prompts: pd.Series) -> pd.Series:
    """A stand-in by rule: closes a case whose prompt names a cause."""
    return prompts.map(lambda p: "CASE CLOSED" if p and "cause" in p.lower() else "CASE NOT CLOSED")


register_model("marker", marker_model)


def cache_key(model: str, prompt: Column, settings: str = "") -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.sha2(prompt, 256), F.lit(settings)), 256)


def classify(http: Column, error: Column) -> Column:
    """`http_<status>` if there was a reply, else the kind of transport error that a message names; null without either."""
    text = F.lower(error)
    kinds = [("read_timeout", "timeout|timed out"), ("remote_protocol_error", "remote protocol"), ("ssl_eof", "ssl"), ("connect_error", "connect|transport|network")]
    out = F.when(http.isNotNull(), F.concat(F.lit("http_"), http.cast("string")))
    for kind, words in kinds:
        out = out.when(text.rlike(words), kind)
    return out.when(error.isNotNull(), "other")


def call_plan(prompts: DataFrame, calls: DataFrame, model: str) -> DataFrame:
    """prompts with prompt_sha and plan: cached, uncertain or call."""
    keyed = prompts.withColumn("prompt_sha", cache_key(model, F.col("prompt")))
    told = {k: F.bool_or(F.col("state") == k).alias(f"_{k}") for k in ("done", "failed")}
    states = calls.groupBy("prompt_sha").agg(*told.values(), F.count("*").alias("_n"), F.bool_or(F.col("state") == "uncertain").alias("_uncertain"))
    plan = F.when(F.col("_done"), "cached").when(F.col("_failed") & ~F.col("_uncertain"), "call").when(F.col("_n") > 0, "uncertain").otherwise("call")
    return keyed.join(states, "prompt_sha", "left").withColumn("plan", plan).drop("_done", "_failed", "_uncertain", "_n")


def _answering(model: Model, wait: tuple[float, ...]):
    """A model that is asked again, after each wait, for what a passing error kept back."""

    def frame(answer) -> pd.DataFrame:
        if isinstance(answer, pd.DataFrame):
            return answer[["reply", "finish_reason", "status", "cost"]].reset_index(drop=True)
        n = len(answer)
        return pd.DataFrame({"reply": list(answer), "finish_reason": ["stop"] * n, "status": ["ok"] * n, "cost": [0.0] * n})

    def answer(prompts: pd.Series) -> pd.DataFrame:
        prompts = prompts.reset_index(drop=True)
        out = frame(model(prompts))
        for seconds in wait:
            again = out.status.isin(RETRIED)
            if not again.any():
                break
            time.sleep(seconds)
            spent = out.cost.where(again, 0.0)
            out.loc[again] = frame(model(prompts[again])).set_index(out.index[again])
            out["cost"] = out.cost + spent
        return out

    return F.pandas_udf(answer, "reply string, finish_reason string, status string, cost double")


def model_call(prompts: DataFrame, calls: DataFrame, stage: str, model: str = "marker", parallel: int | None = None, wait: tuple[float, ...] = ()) -> DataFrame:
    """New rows of the calls table, one for each prompt that has to be called; equal prompts are called once.
    parallel caps how many partitions call at once; wait: how long to wait before each further try, none by default. A
    truncated reply is a failure, whatever it holds."""
    wanted = call_plan(prompts, calls, model).where("plan = 'call'").select("prompt_sha", "prompt").dropDuplicates(["prompt_sha"])
    if parallel:
        wanted = wanted.orderBy(F.length("prompt").desc()).repartition(parallel)
    told = wanted.withColumn("_r", _answering(MODELS[model], wait)("prompt"))
    state = F.when(F.col("_r.status") == "ok", "done").when(F.col("_r.status").startswith("http_"), "failed").otherwise("uncertain")
    return told.select("prompt_sha", F.lit(stage).alias("stage"), state.alias("state"), "_r.reply", "_r.finish_reason", "_r.cost")


class BudgetSpent(RuntimeError):
    """No call is begun once the money is spent."""


def known_calls(spark: SparkSession, path: str) -> DataFrame:
    """The calls table at a path, empty if there is none yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CALLS)
    return spark.read.schema(CALLS).parquet(path)


def call_once(spark: SparkSession, prompts: DataFrame, path: str, stage: str, model: str = "marker", budget: float | None = None, **options) -> DataFrame:
    """Make the calls that are still to be made and return prompts with plan, reply and finish_reason. Every call is written
    down as inflight before it is made, so a run that dies leaves calls that are told from those never begun."""
    from evispark.storage import release, staged

    calls = known_calls(spark, path)
    if budget is not None and over_budget(calls, budget):
        raise BudgetSpent(f"the calls at {path} have cost {budget} or more")
    plan = staged(call_plan(prompts, calls, model), "plan")
    begun = plan.where("plan = 'call'").select("prompt_sha").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    begun.select("prompt_sha", F.lit(stage).alias("stage"), F.lit("inflight").alias("state"), none("string").alias("reply"), none("string").alias("finish_reason"), F.lit(0.0).alias("cost")).write.mode("append").parquet(path)
    made = staged(model_call(plan.where("plan = 'call'").drop("plan", "prompt_sha"), spark.createDataFrame([], CALLS), stage, model, **options), "calls")
    made.write.mode("append").parquet(path)
    release(made)
    best = usable(known_calls(spark, path)).groupBy("prompt_sha").agg(F.min(F.struct("reply", "finish_reason")).alias("_r"))
    return plan.join(best, "prompt_sha", "left").select(*plan.columns, "_r.reply", "_r.finish_reason")


def format_retries(answered: DataFrame, problem: Column, note: str = "Your previous reply was rejected: ") -> DataFrame:
    """Prompts of a second stage: those whose reply a validator rejects, with its finding. answered: prompt, reply."""
    rows = answered.withColumn("_problem", problem).where(F.col("reply").isNotNull() & F.col("_problem").isNotNull())
    return rows.withColumn("prompt", F.concat(F.col("prompt"), F.lit("\n\n" + note), F.col("_problem"), F.lit(". Answer again."))).drop("_problem", "reply", "finish_reason", "plan", "prompt_sha")


def usable(calls: DataFrame) -> DataFrame:
    return calls.where("state = 'done' AND finish_reason <> 'length'")


def over_budget(calls: DataFrame, limit: float) -> bool:
    """Whether the money is spent; asked between batches."""
    return calls.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("c")).first()["c"] >= limit


def run_stages(spark: SparkSession, cases: str, out: str, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], checkpoint: str, schema: str, stop: Callable[[], bool] | None = None) -> list[str]:
    """Each stage is a stream over the table of the one before it, so cases go on by themselves; every stage commits its
    batches once, by batch id. Runs until all that is there is done, or until `stop` says so between two stages; what is
    committed stays, and a later run goes on from there. The names of the stages that ran."""
    source, ran = cases, []
    for name, stage in stages:
        if stop is not None and stop():
            break
        target = f"{out}/{name}"

        def commit(batch: DataFrame, batch_id: int, stage=stage, target=target) -> None:
            stage(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", True).parquet(source)
        stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start().awaitTermination()
        source = target
        schema = spark.read.option("recursiveFileLookup", True).parquet(target).schema
        ran.append(name)
    return ran
