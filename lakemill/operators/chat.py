"""Conversations and preferences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def pairs(turns: DataFrame, history: int = 4, instructions: str = "", most_chars: int = 8000, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id, turn, prompt, answer): user and assistant turns that aren't blank; the prompt holds up to `history` turns before the user's."""
    rows = turns.select(conv, turn, T.role(F.col("role")).alias("role"), T.collapsed(F.col("text")).alias("t")).where("role IN ('user', 'assistant') AND t <> ''")
    order = Window.partitionBy(conv).orderBy(turn)
    line = F.concat(F.initcap("role"), F.lit(": "), F.col("t"))
    seen = rows.withColumn("before", F.lag("role").over(order)).withColumn("asked", F.lag("t").over(order)).withColumn("past", F.collect_list(line).over(order.rowsBetween(-history - 1, -2)))
    head = [F.lit(f"Follow these instructions while replying: {instructions}")] if instructions else []
    told = F.concat_ws("\n", *head, F.when(F.size("past") > 0, F.concat(F.lit("Conversation so far:\n"), F.array_join("past", "\n"))), F.concat(F.lit("User: "), F.col("asked")))
    prompt = F.when((F.size("past") > 0) | F.lit(bool(instructions)), told).otherwise(F.col("asked"))
    return seen.where("role = 'assistant' AND before = 'user'").select(conv, turn, F.substring(prompt, 1, most_chars).alias("prompt"), F.col("t").alias("answer"))


def last_response(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id, prompt, response): the turns before the last assistant turn, and that turn."""
    rows = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, "role", "text"))).alias("m"))
    at = F.array_max(F.transform(F.filter("m", lambda x: x["role"] == "assistant"), lambda x: x[turn]))
    rows = rows.withColumn("at", at).where("at IS NOT NULL")
    before = F.filter("m", lambda x: x[turn] < F.col("at"))
    own = F.filter("m", lambda x: x[turn] == F.col("at"))
    return rows.select(conv, F.transform(before, lambda x: x["text"]).alias("prompt"), F.get(own, F.lit(0))["text"].alias("response"))


def valid_preference(prompt: Column, chosen: Column, rejected: Column) -> Column:
    return (F.trim(prompt) != "") & (F.trim(chosen) != "") & (F.trim(rejected) != "") & (chosen != rejected)


def best_and_worst(rows: DataFrame, prompt: str, answer: str, rating: str, key: str) -> DataFrame:
    """(prompt, chosen, rejected, weight) where ratings differ; ties go to the smaller key."""
    best = F.max_by(answer, F.struct(F.col(rating), -F.col(key)))
    worst = F.min_by(answer, F.struct(rating, key))
    spread = F.max(rating) - F.min(rating)
    return rows.groupBy(prompt).agg(best.alias("chosen"), worst.alias("rejected"), spread.alias("weight")).where("weight > 0").withColumn("weight", F.greatest("weight", F.lit(1)).cast("bigint"))


def first_right_and_wrong(rows: DataFrame, prompt: str, answer: str, right: Column, key: str) -> DataFrame:
    first = lambda ok: F.min_by(F.when(ok, F.col(answer)), F.when(ok, F.col(key)))
    return rows.groupBy(prompt).agg(first(right).alias("chosen"), first(~right).alias("rejected")).where("chosen IS NOT NULL AND rejected IS NOT NULL")


# Marks of thoughts and solutions.
THOUGHT = r"(?s)<\|begin_of_thought\|>(.*?)<\|end_of_thought\|>"
SOLUTION = r"(?s)<\|begin_of_solution\|>(.*?)<\|end_of_solution\|>"
THINK = r"(?is)<think>(.*?)</think>"


def reasoning(text: Column, tidy=T.collapsed) -> tuple[Column, Column]:
    """(thought, answer): by thought and solution marks if there are any (the answer is the whole text without a solution), else by the first think block
    (the answer is the text without such blocks), else no thought."""
    marked, think = text.rlike(THOUGHT) | text.rlike(SOLUTION), text.rlike(THINK)
    thought = F.when(marked, F.regexp_extract(text, THOUGHT, 1)).when(think, F.regexp_extract(text, THINK, 1)).otherwise("")
    answer = F.when(marked & text.rlike(SOLUTION), F.regexp_extract(text, SOLUTION, 1)).when(~marked & think, F.regexp_replace(text, THINK, "")).otherwise(text)
    return tidy(thought), tidy(answer)


def shortened(text: Column, keep_thought: bool, most_thought: int, most_answer: int, most: int) -> Column:
    """The answer alone, or behind its thought in a think block; each cut and tidied."""
    thought, answer = reasoning(text)
    if not keep_thought:
        return T.collapsed(F.substring(answer, 1, most))
    thought, answer = T.collapsed(F.substring(thought, 1, most_thought)), T.collapsed(F.substring(answer, 1, most_answer))
    return F.when(thought != "", T.stripped(F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n\n"), answer))).otherwise(answer)


def chatml(text: Column, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>"), F.lit(group))


# Openers, phrases and marks by which poor replies are told, and their bounds.
POLISHED_OPENERS = ["sure", "absolutely", "certainly", "of course", "here's", "here is", "gladly", "definitely"]
FAKE_CONFIDENCE = ["definitely", "certainly", "without a doubt", "clearly", "obviously", "there is no question"]
REASONING_MARKERS = ["let's think", "step by step", "first,", "second,", "third,", "therefore", "thus", "because", "so ", "we can see"]
FINAL_ANSWER = ["final answer", "answer:", "therefore the answer", "thus the answer", "so the answer", "in conclusion"]
LAST_LINE_OPENERS = ["answer", "final"]
VERBOSE = {"chat": (1.55, 160, 360), "think": (1.35, 100, 220)}


def _any(words: Sequence[str], holds) -> Column:
    return F.exists(F.array(*map(F.lit, words)), holds)


def _count(text: Column, words: Sequence[str]) -> Column:
    """Occurrences of all words, each counted without overlaps."""
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w) for w in words[1:]), (F.length(text) - F.length(F.replace(text, F.lit(words[0]), F.lit("")))) / len(words[0])).cast("int")


def _verbose(reply: Column, chosen: Column, kind: str) -> Column:
    factor, more, least = VERBOSE[kind]
    n = F.length(chosen)
    return F.length(reply) >= F.greatest(F.floor(n * factor), n + more, F.lit(least))


def _judged(checks: Sequence[tuple[str, Column, int]], least: int, needs) -> Column:
    """struct(reasons, score) of the checks that hold; empty and 0 under the least score or without the reasons needed."""
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c, _ in checks]))
    score = sum((F.when(c, n).otherwise(0) for _, c, n in checks[1:]), F.when(checks[0][1], checks[0][2]).otherwise(0))
    none = F.struct(F.array().cast("array<string>").alias("reasons"), F.lit(0).alias("score"))
    return T.bound(F.struct(reasons.alias("reasons"), score.alias("score")), lambda x: F.when((x["score"] >= least) & needs(x["reasons"]), x).otherwise(none))


def chat_negative(reply: Column, chosen: Column) -> Column:
    """struct(reasons, score) of a poor chat reply: far longer than the chosen one, with a polished opener, fake confidence, or too much structure."""
    low = F.lower(reply)
    lines, bullets = F.length(reply) - F.length(F.replace(reply, F.lit("\n"), F.lit(""))), _count(reply, ["\n- ", "\n* "]) + T.number_of(reply, r"\n\d+\.\s")
    has = lambda r, *names: F.arrays_overlap(r, F.array(*map(F.lit, names)))
    return _judged(
        [
            ("oververbose", _verbose(reply, chosen, "chat"), 2),
            ("polished_opener", _any(POLISHED_OPENERS, lambda w: F.startswith(low, w)), 1),
            ("fake_confidence", _any(FAKE_CONFIDENCE, lambda w: F.contains(low, w)), 1),
            ("overstructured", (lines >= 4) | (bullets >= 2), 1),
        ],
        2,
        lambda r: has(r, "oververbose", "fake_confidence", "overstructured"),
    )


def think_negative(reply: Column, chosen: Column) -> Column:
    """struct(reasons, score) of a poor reply with reasoning: think blocks, a trace of markers, length, no clear final answer, fake confidence."""
    low = F.lower(reply)
    tail = F.coalesce(F.try_element_at(T.lines(low), F.lit(-1)), F.lit(""))
    final = _any(FINAL_ANSWER, lambda w: F.contains(low, w)) | T.bound(tail, lambda t: (F.length(t) <= 120) & _any(LAST_LINE_OPENERS, lambda w: F.startswith(t, w)))
    has = lambda r, *names: F.arrays_overlap(r, F.array(*map(F.lit, names)))
    return _judged(
        [
            ("think_tags", reply.rlike(THINK), 2),
            ("reasoning_trace", _count(low, REASONING_MARKERS) >= 3, 1),
            ("verbose", _verbose(reply, chosen, "think"), 1),
            ("no_clear_final", ~final, 2),
            ("fake_confidence", _any(FAKE_CONFIDENCE, lambda w: F.contains(low, w)), 1),
        ],
        3,
        lambda r: has(r, "no_clear_final") & has(r, "reasoning_trace", "think_tags"),
    )


# readers of preference sets


def payload(rows: DataFrame, prompt: Column, chosen: Column, rejected: Column, weight: Column, keep: Sequence[str] = (), drop_code: bool = False) -> DataFrame:
    """(keep, prompt, chosen, rejected, pair_weight) of valid pairs, tidied."""
    from .evidence import holds_code

    cooked = rows.select(*keep, *[T.collapsed(c).alias(n) for n, c in (("prompt", prompt), ("chosen", chosen), ("rejected", rejected))], weight.cast("double").alias("pair_weight"))
    valid = cooked.where((F.col("prompt") != "") & (F.col("chosen") != "") & (F.col("rejected") != "") & (F.col("chosen") != F.col("rejected")))
    return valid.where(~holds_code(F.col("prompt"), F.col("chosen"), F.col("rejected"))) if drop_code else valid


def rating(value: Column) -> Column:
    """A number, or text that is one; 0 for anything else."""
    return F.coalesce(F.trim(value.cast("string")).try_cast("double"), F.lit(0.0))


def preferred_of_two(rows: DataFrame, prompt: Column, first: Column, second: Column, preference: Column, keep: Sequence[str] = (), positive_is_second: bool = True, drop_code: bool = False) -> DataFrame:
    """Pairs by the sign of a preference, weighted by its size (1 at least); ties are no pairs."""
    second_wins = (preference > 0) if positive_is_second else (preference < 0)
    told = rows.where(F.coalesce(preference, F.lit(0)) != 0)
    return payload(told, prompt, F.when(second_wins, second).otherwise(first), F.when(second_wins, first).otherwise(second), F.greatest(F.abs(preference), F.lit(1.0)), keep, drop_code)


def _ranked(items: Column, score) -> Column:
    """Items by falling score, the first of equals first, as struct(score, place, item)."""
    return F.array_sort(F.transform(items, lambda x, i: F.struct((-score(x)).alias("s"), i.alias("i"), x.alias("x"))))


def best_and_worst_of(rows: DataFrame, prompt: Column, items: str, answer: str, score, keep: Sequence[str] = (), drop_code: bool = False) -> DataFrame:
    """Pairs of the first and the last of an array of answers by score, where the scores differ; weighted by the difference (1 at least)."""
    some = F.filter(items, lambda x: F.coalesce(x[answer], F.lit("")) != "")
    ranked = rows.select(*keep, prompt.alias("_p"), _ranked(some, score).alias("_r")).where("size(_r) >= 2")
    best, worst = F.element_at("_r", 1), F.element_at("_r", -1)
    told = ranked.where(best["s"] < worst["s"])
    return payload(told, F.col("_p"), best["x"][answer], worst["x"][answer], F.greatest(worst["s"] - best["s"], F.lit(1.0)), keep, drop_code)


def annotated_score(completion: Column, fields: Sequence[str], answer: str, moderate: bool = False) -> Column:
    """The sum of the ratings of an answer's annotations; long and very short answers lose if moderate length is preferred."""
    total = sum((rating(completion["annotations"][f]) for f in fields[1:]), rating(completion["annotations"][fields[0]]))
    n = F.length(completion[answer])
    return total - F.when(n > 1600, 1.0).when(n < 80, 0.5).otherwise(0.0) if moderate else total


def ranked_answers(rows: DataFrame, prompt: Column, items: str, answer: str, rank: str, seed: Column, keep: Sequence[str] = (), sampled: bool = False, drop_code: bool = False) -> DataFrame:
    """Pairs of the best rank and the last; if sampled, also with one of the worse half, chosen by a hash of the seed, unless it says what the last one says."""
    ranked = rows.select(*keep, prompt.alias("_p"), F.array_sort(F.transform(items, lambda x, i: F.struct(F.coalesce(x[rank], F.lit(999)).alias("s"), i.alias("i"), x[answer].alias("x")))).alias("_r"), seed.alias("_seed")).where("size(_r) >= 2")
    last, best = F.element_at("_r", -1), F.element_at("_r", 1)
    rejected = F.array(last)
    if sampled:
        half = F.greatest(F.lit(1), F.floor(F.size("_r") / 2).cast("int"))
        other = F.get("_r", (half + F.pmod(F.xxhash64("_seed"), F.size("_r") - half)).cast("int"))
        rejected = F.when((F.size("_r") > 2) & (other["x"] != last["x"]), F.array(last, other)).otherwise(rejected)
    each = ranked.select(*keep, "_p", best.alias("_b"), F.explode(rejected).alias("_w")).where("_b.s < _w.s")
    return payload(each, F.col("_p"), F.col("_b.x"), F.col("_w.x"), F.greatest(F.col("_w.s") - F.col("_b.s"), F.lit(1)), keep, drop_code)


def verified_generations(rows: DataFrame, prompt: Column, generations: str, correct: str, keep: Sequence[str] = (), drop_code: bool = False) -> DataFrame:
    """Pairs of the first right and the first wrong generation that isn't empty; weight 2."""
    both = F.filter(F.arrays_zip(F.col(generations).alias("g"), F.col(correct).alias("c")), lambda x: F.coalesce(x["g"], F.lit("")) != "")
    first = lambda ok: F.get(F.filter(both, lambda x: F.coalesce(x["c"], F.lit(False)) == ok), F.lit(0))["g"]
    whole = rows.where((F.size(generations) >= 2) & (F.size(generations) == F.size(correct)))
    return payload(whole, prompt, F.coalesce(first(F.lit(True)), F.lit("")), F.coalesce(first(F.lit(False)), F.lit("")), F.lit(2.0), keep, drop_code)


def named_pairs(rows: DataFrame, prompts: Sequence[str], chosen: Sequence[str], rejected: Sequence[str], keep: Sequence[str] = (), drop_code: bool = False) -> DataFrame:
    """Pairs by the first of several column names that is there and not empty; weight 1."""
    first = lambda names: F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in names if c in rows.columns], F.lit(""))
    return payload(rows, first(prompts), first(chosen), first(rejected), F.lit(1.0), keep, drop_code)


def message_prompt(prompt: Column) -> Column:
    """Turns marked Human and Assistant as User and Assistant, without an open last turn."""
    cooked = F.replace(F.replace(F.replace(prompt, F.lit("\n\nHuman:"), F.lit("\nUser:")), F.lit("\n\nAssistant:"), F.lit("\nAssistant:")), F.lit("Human:"), F.lit("User:"))
    return T.stripped(F.regexp_replace(T.collapsed(cooked), r"\s*Assistant:$", ""))
