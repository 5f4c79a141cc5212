"""Training sequences out of rollouts: what each turn generated, laid over the last turn's prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.functions.arrays import ids_digest


def assemble(turns: DataFrame, prompts: DataFrame, keys: list[str]) -> DataFrame:
    """By rollout: error, input_ids, loss_mask, behaviour_logprobs, turn_status, target_tokens.

    turns: keys, turn, prompt_len, prompt_sha, gen_ids, logprobs; prompts: keys, prompt_ids, of the last turn that
    generated. The sequence is that prompt and what the last turn generated. An earlier turn counts only if its own
    prompt and tokens stand in the sequence where it says, and any turn only with a log-probability for each token. A
    rollout whose prompt doesn't reproduce has an error and no sequence; one without generated tokens gives no row.
    """
    spoke = F.size(F.coalesce("gen_ids", F.array().cast("array<int>"))) > 0
    last = turns.where(spoke).groupBy(*keys).agg(F.max_by(F.struct("turn", "prompt_len", "prompt_sha", "gen_ids"), "turn").alias("last"))
    whole = last.join(prompts, keys)
    good = (F.size("prompt_ids") == F.col("last.prompt_len")) & (ids_digest(F.col("prompt_ids")) == F.col("last.prompt_sha"))
    whole = whole.select(*keys, F.col("last.turn").alias("_last"), good.alias("_good"), F.concat("prompt_ids", "last.gen_ids").alias("input_ids"))
    joined = turns.join(whole, keys).withColumn("_end", F.col("prompt_len") + F.size("gen_ids"))
    before, seq = F.col("turn") < F.col("_last"), F.col("input_ids")
    moved = (F.col("_end") > F.size(seq)) | (ids_digest(F.slice(seq, F.lit(1), F.col("prompt_len"))) != F.col("prompt_sha"))
    status = (
        F.when(~spoke, "no_tokens").when(before & moved, "mismatch_prefix")
        .when(before & (F.slice(seq, F.col("prompt_len") + 1, F.size("gen_ids")) != F.col("gen_ids")), "mismatch_tokens")
        .when(F.col("logprobs").isNull() | F.exists("logprobs", lambda x: x.isNull()), "no_logprobs").otherwise("ok")
    )
    span = F.struct("turn", F.col("prompt_len").alias("start"), F.col("_end").alias("end"), F.when(F.col("_status") == "ok", F.col("logprobs")).alias("values"), F.col("_status").alias("status"))
    listed = joined.withColumn("_status", status).groupBy(*keys).agg(F.sort_array(F.collect_list(span)).alias("_spans"))
    out = whole.join(listed, keys)
    ok = F.filter("_spans", lambda s: s["status"] == "ok")

    def value(i):
        mine = F.filter(F.col("_ok"), lambda s: (s["start"] <= i) & (i < s["end"]))
        return F.when(F.size(mine) > 0, F.get(F.element_at(mine, -1)["values"], i - F.element_at(mine, -1)["start"]))

    out = out.withColumn("_ok", ok).withColumn("_values", F.transform(F.sequence(F.lit(0), F.size("input_ids") - 1), value))
    only = lambda c: F.when(F.col("_good"), c)
    mask = F.transform("_values", lambda v: v.isNotNull().cast("int"))
    return out.select(
        *keys, F.when(~F.col("_good"), "the last prompt does not reproduce").alias("error"), only(F.col("input_ids")).alias("input_ids"), only(mask).alias("loss_mask"),
        only(F.transform("_values", lambda v: F.coalesce(v, F.lit(0.0)))).alias("behaviour_logprobs"), only(F.transform("_spans", lambda s: s["status"])).alias("turn_status"),
        only(F.size(F.filter("_values", lambda v: v.isNotNull()))).alias("target_tokens"),
    )


def against_masks(sequences: DataFrame, supervised: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a rollout's tokens are the supervised rendering's, and what each mask has that the other hasn't.
    supervised: keys, ids, labels."""
    from evispark.functions import arrays as a

    both = sequences.join(supervised, keys).withColumn("_mask", a.loss_mask(F.col("labels")))
    longer = F.size("ids") - F.size("input_ids")
    return both.select(
        *keys, (a.starts_with(F.col("ids"), F.col("input_ids")) & longer.isin(0, 1)).alias("same_ids"),
        a.within_mask(F.col("loss_mask"), F.col("_mask")).alias("within"), a.only_in_first(F.col("_mask"), F.col("loss_mask")).alias("supervised_only"),
    )
