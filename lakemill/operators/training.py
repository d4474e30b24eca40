"""Conversations as token ids, reasoning examples, samples of a release, and measures of training runs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .chat import reasoning
from .tokenizing import _tokenizer

#: The label of a token that is not learnt.
IGNORED = -100


def chat_ids(rows: DataFrame, path: str, prefixes: Mapping[str, str], begin: int | None, end: int | None, most: int, keep_tail: bool = True, key: str = "conv_id", messages: str = "messages") -> DataFrame:
    """(key, input_ids, labels) of conversations, arrays of structs with role and content: each message as `prefix: content` and a line end.

    Only the assistant's tokens are learnt, and the end token if the assistant speaks last. Conversations without any are left out; of those over `most` ids the last
    ones stay, or none if keep_tail is off.
    """

    def one(turns) -> tuple[list[int], list[int]] | None:
        ids, labels, last = [begin] * (begin is not None), [IGNORED] * (begin is not None), None
        for m in turns:
            last = m["role"].strip().lower()
            own = _tokenizer(path).encode(f"{prefixes[last]}: {m['content'].strip()}\n", add_special_tokens=False).ids
            ids += own
            labels += own if last == "assistant" else [IGNORED] * len(own)
        if end is not None:
            ids.append(end)
            labels.append(end if last == "assistant" else IGNORED)
        if len(ids) > most and not keep_tail:
            return None
        ids, labels = ids[-most:], labels[-most:]
        return (ids, labels) if any(x != IGNORED for x in labels) and any(m["role"].strip().lower() == "assistant" for m in turns) else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [(k, x) for k, x in zip(part[key], map(one, part[messages])) if x]
            yield pd.DataFrame([(k, ids, labels) for k, (ids, labels) in made], columns=[key, "input_ids", "labels"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, messages).mapInPandas(run, f"{key} {kind}, input_ids array<bigint>, labels array<bigint>")


def instruction_messages(instruction: Column, more: Column, output: Column) -> Column:
    """A user's and an assistant's message; the instruction's input under it if there is any."""
    asked, extra = T.stripped(instruction), T.stripped(F.coalesce(more, F.lit("")))
    prompt = F.when(extra == "", asked).otherwise(F.concat(asked, F.lit("\n\nInput:\n"), extra))
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")), F.struct(F.lit("assistant").alias("role"), output.alias("content")))


#: Stands for a thought that isn't there.
NO_THOUGHT = "I break the problem into smaller steps and check the important constraints."


def _tidied(text: Column) -> Column:
    return F.regexp_replace(T.stripped(text), "\n{3,}", "\n\n")


def reasoning_text(thought: Column, solution: Column, think_tags: bool) -> Column:
    """A thought and a solution as one reply, in a think block or in sections."""
    sections = F.concat(F.lit("Thought:\n"), thought, F.lit("\n\nSolution:\n"), solution)
    if not think_tags:
        return T.stripped(sections)
    return T.stripped(F.when(thought != "", F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n\n"), solution)).otherwise(sections))


def reasoning_examples(turns: DataFrame, most_user: int = 500, most_thought: int = 700, most_solution: int = 300, think_tags: bool = False, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id, user, reply) from the first two turns: both not blank and a solution not empty; each part cut, and a stock thought where there is none."""
    first = turns.groupBy(conv).agg(F.slice(F.array_sort(F.collect_list(F.struct(turn, "text"))), 1, 2).alias("m")).where("size(m) = 2")
    both = first.select(conv, T.stripped(F.get("m", F.lit(0))["text"]).alias("u"), T.stripped(F.get("m", F.lit(1))["text"]).alias("a")).where("u <> '' AND a <> ''")
    thought, solution = reasoning(F.col("a"), _tidied)
    cut = lambda c, n: T.stripped(F.substring(c, 1, n))
    parts = both.select(conv, cut(F.col("u"), most_user).alias("user"), thought.alias("t"), solution.alias("s")).where("s <> ''")
    parts = parts.select(conv, "user", cut(F.col("t"), most_thought).alias("t"), cut(F.col("s"), most_solution).alias("s"))
    return parts.select(conv, "user", reasoning_text(F.when(F.col("t") == "", NO_THOUGHT).otherwise(F.col("t")), F.col("s"), think_tags).alias("reply"))


def strided_blocks(phases: DataFrame, budget: int, block: int, phase: str = "phase", start: str = "start", tokens: str = "tokens") -> DataFrame:
    """(step, phase, cursor): each phase's share of the budget in whole blocks, spread over the phase by a whole stride. One row a phase comes in."""
    whole, order = Window.partitionBy(), Window.orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    share = F.expr(f"CAST(CAST({budget} AS DECIMAL(38,0)) * {tokens} DIV _total AS BIGINT) DIV {block}")
    plan = phases.withColumn("_total", F.sum(tokens).over(whole).cast("decimal(20,0)")).withColumn("_blocks", share).where("_blocks > 0")
    plan = plan.withColumn("_stride", F.greatest(F.lit(1), F.expr(f"({tokens} DIV {block}) DIV _blocks"))).withColumn("_before", F.coalesce(F.sum("_blocks").over(order), F.lit(0)))
    each = plan.select(phase, start, "_stride", "_before", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_i"))
    return each.select((F.col("_before") + F.col("_i")).alias("step"), phase, (F.col(start) + F.col("_i") * F.col("_stride") * block).cast("bigint").alias("cursor"))


def effect_summary(losses: DataFrame, least_gain: float, sequence: str = "row", place: str = "pos", document: str = "doc", repeat: str = "repeat") -> DataFrame:
    """(region, tokens, loss_sum_gain, mean_loss_gain, repeat_range, above_noise, tokens_above, most_change) of losses before and after a change.

    Regions are the changed places, those behind one in the same document, the unaffected rest, and all. A token's gain is the fall of its mean over repeats; what the unaffected
    tokens change and vary is the noise that others have to exceed threefold. One row a region comes out of sums and extremes.
    """
    at = [sequence, place, document]
    tokens = losses.groupBy(*at).agg((F.avg("before") - F.avg("after")).alias("gain"), (F.max("before") - F.min("before") + F.max("after") - F.min("after")).alias("spread"), F.bool_or("changed").alias("changed"))
    first = tokens.where("changed").groupBy(sequence, document).agg(F.min(place).alias("_first"))
    told = tokens.join(first, [sequence, document], "left").withColumn("region", F.when(F.col("changed"), "changed").when(F.col(place) > F.col("_first"), "downstream").otherwise("unaffected"))
    sums = losses.join(told.select(*at, "region"), at).withColumn("region", F.explode(F.array("region", F.lit("total")))).groupBy("region", repeat).agg(F.sum("before").alias("b"), F.sum("after").alias("a"))
    spans = sums.groupBy("region").agg((F.max("b") - F.min("b") + F.max("a") - F.min("a")).alias("repeat_range"))
    quiet = told.where("region = 'unaffected'").agg(F.coalesce(F.max(F.abs("gain")), F.lit(0.0)).alias("_c"), F.coalesce(F.max("spread"), F.lit(0.0)).alias("_r")).select(F.greatest(F.lit(least_gain), F.col("_c") * 3, F.col("_r") * 3).alias("_noise")).first()
    each = told.withColumn("region", F.explode(F.array("region", F.lit("total"))))
    out = each.groupBy("region").agg(F.count("*").alias("tokens"), F.sum("gain").alias("loss_sum_gain"), F.avg("gain").alias("mean_loss_gain"), F.count(F.when(F.abs("gain") > quiet["_noise"], 1)).alias("tokens_above"), F.max(F.abs("gain")).alias("most_change"))
    return out.join(spans, "region").withColumn("above_noise", F.abs("loss_sum_gain") > F.greatest(F.lit(least_gain), F.col("repeat_range") * 3))


def length_budget(pass_rate: Column, mean_correct: Column, most: Column) -> Column:
    """Tokens that an answer may take: near the mean of right ones where the task is easy, near the most where it is hard."""
    return pass_rate * mean_correct + (1 - pass_rate) * most


def length_reward(correct: Column, length: Column, budget: Column, coefficient: float = 0.05, deadband: float = 0.10) -> Column:
    """Correctness, and for right answers up to `coefficient` more or less as they keep near the budget; wrong ones get nothing for length."""
    off = F.abs(length - budget) / F.greatest(budget, F.lit(1.0))
    outside = F.least(F.lit(2.0), F.greatest(F.lit(0.0), (off - deadband) / max(1 - deadband, 1e-6)))
    return correct + F.when(correct > 0, (1 - outside) * coefficient).otherwise(0.0)


def group_rewards(rows: DataFrame, compliance_weight: float, by: str = "prompt", correct: str = "correct", length: str = "length", thinks: str = "thinks", compliance: str = "compliance", most_length: str = "most_length") -> DataFrame:
    """rows with pass_rate, mean_correct_length and reward: of prompts answered with thinking the length counts; what breaks the mode costs its weight."""
    of = Window.partitionBy(by)
    ok, n = F.col(correct).cast("double"), F.greatest(F.col(length), F.lit(1)).cast("double")
    rated = rows.withColumn("pass_rate", F.avg(ok).over(of)).withColumn("mean_correct_length", F.sum(n * ok).over(of) / F.greatest(F.sum(ok).over(of), F.lit(1.0)))
    shaped = F.when(F.col(thinks), length_reward(ok, n, length_budget(F.col("pass_rate"), F.col("mean_correct_length"), F.col(most_length)))).otherwise(ok)
    return rated.withColumn("reward", shaped - compliance_weight * (1 - F.col(compliance)))


def fingerprint(domain: str, **fields: Column) -> Column:
    """SHA-256 of named arrays of numbers: the domain, then each name, length and values."""
    parts = [x for name, c in fields.items() for x in (F.lit(name), F.size(c).cast("string"), F.array_join(c.cast("array<string>"), ","))]
    return F.sha2(F.concat_ws("\x00", F.lit(domain), *parts).cast("binary"), 256)


def prompt_fingerprints(rows: DataFrame, ids: str, prompt_length: str, domain: str = "prompt/v1") -> DataFrame:
    """rows with the fingerprint of the first prompt_length ids."""
    return rows.withColumn("fingerprint", fingerprint(domain, prompt_input_ids=F.slice(ids, 1, F.col(prompt_length))))


def overlap(train: DataFrame, evaluation: DataFrame, by: str = "fingerprint") -> DataFrame:
    """(fingerprint, train_rows, eval_rows) of what both hold; none in a sound split."""
    a, b = train.groupBy(by).agg(F.count("*").alias("train_rows")), evaluation.groupBy(by).agg(F.count("*").alias("eval_rows"))
    return a.join(b, by)


def window_bounds(length: int, size: int, stride: int) -> np.ndarray:
    """(context start, target start, target end) of rolling windows: each token is a target once."""
    starts = np.arange(0, length, stride)
    ends = np.minimum(starts + stride, length)
    return np.stack([np.maximum(0, ends - size), starts, ends], axis=1)
