"""Evaluation of stored predictions: summaries, style, resampling and checkpoint choice."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import scores as S
from parley.functions import text as T
from parley.operators import phrases
from parley.operators.curation import ranked_rows

BOOTSTRAP, MIN_DELTA, MIN_P = 1000, 0.02, 0.95
#: Cumulative Poisson(1) probabilities of 0 to 9: a draw in [0, 1) counts as many times as it reaches.
_POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(10))


def scored(rows: DataFrame, pred: str = "pred", gold: str = "gold", prompt: str = "prompt") -> DataFrame:
    """Add chrf, rouge_l, len_ratio, copied, exact and score."""
    p, g = (T.strip(T.text_or_empty(F.col(c))) for c in (pred, gold))
    rows = rows.withColumns({"_p": p, "_g": g})
    rows = rows.withColumns({
        "chrf": S.chrf("_p", "_g"), "rouge_l": S.rouge_l("_p", "_g"), "len_ratio": F.char_length("_p") / F.greatest(F.char_length("_g"), F.lit(1)),
        "copied": T.copied_from_prompt(F.col("_p"), F.col(prompt)), "exact": F.col("_p") == F.col("_g"),
    })
    return rows.withColumn("score", S.ranking(F.col("chrf"), F.col("rouge_l"), F.col("len_ratio"), F.col("copied"))).drop("_p", "_g")


def text_stats(c: Column) -> dict[str, Column]:
    """Characters, words, bubbles, emoji, capitals and final punctuation of a reply."""
    t = T.text_or_empty(c)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return {
        "chars": F.char_length(t), "words": F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")), "bubbles": F.greatest(F.size(T.split_bubbles(c)), F.lit(1)),
        "emoji": T.emoji_runs(c), "upper_frac": F.coalesce(F.length(F.regexp_replace(t, r"[^\p{Lu}]", "")) / F.nullif(letters, F.lit(0)), F.lit(0.0)), "ends_punct": t.rlike(r"[.!?]$"),
    }


def upper_median(value: str) -> Column:
    """The element at n // 2 of the sorted values of an SQL expression: from above, the first that half of them reach."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def style_features(rows: DataFrame, text: str) -> DataFrame:
    """One row of corpus features of replies."""
    t = F.col(text)
    rows = rows.where(t.isNotNull()).withColumn("_spam", S.degenerate(t))
    count = lambda p: F.sum(F.length(F.regexp_replace(t, p, "")))
    share = lambda c: F.avg(c.cast("double"))
    return rows.agg(
        upper_median(f"char_length(`{text}`)").cast("int").alias("median_chars"),
        F.avg(F.size(T.split_bubbles(t))).alias("bubbles"), F.coalesce(count(r"[^\p{Ll}]") / F.nullif(count(r"[^\p{L}]"), F.lit(0)), F.lit(0.0)).alias("lower_frac"),
        share(t.rlike(r"^\p{Lu}")).alias("caps_start"), share(t.rlike(r"[.!?]$")).alias("ends_punct"), F.avg(T.emoji_runs(t)).alias("emoji_per_reply"),
        share(F.char_length(t) <= 12).alias("short_frac"), share(F.col("_spam")).alias("degenerate"),
    )


def initiative(rows: DataFrame, text: str, incoming: str) -> DataFrame:
    """One row: shares of questions and acknowledgements, and the mean share of words that the incoming text lacks."""
    words, prior = F.array_distinct(T.word_tokens(F.col(text))), T.word_tokens(F.col(incoming))
    new = F.when(F.size(words) > 0, F.size(F.array_except(words, prior)) / F.size(words)).otherwise(0.0)
    return rows.agg(F.avg(F.contains(T.text_or_empty(F.col(text)), F.lit("?")).cast("double")).alias("question"), F.avg(T.is_ack(F.col(text)).cast("double")).alias("ack"), F.avg(new).alias("new_words"))


def style_distance(rows: DataFrame, pred: str = "pred", gold: str = "gold", incoming: str | None = None) -> DataFrame:
    """One row: gaps between the features of predicted and true replies, and their weighted sum."""
    p = style_features(rows, pred)
    g = style_features(rows, gold)
    both = p.select(*(F.col(c).alias(f"p_{c}") for c in p.columns)).crossJoin(F.broadcast(g.select(*(F.col(c).alias(f"g_{c}") for c in g.columns))))
    both = both.crossJoin(F.broadcast(phrases.vocab_overlap(phrases.vocabulary(rows, pred), phrases.vocabulary(rows, gold)))).withColumn("vocab_overlap", F.coalesce("overlap", F.lit(0.0)))
    gap = lambda c: F.abs(F.col(f"p_{c}") - F.col(f"g_{c}"))
    length = F.abs(F.log(F.greatest(F.lit(1), F.col("p_median_chars")) / F.greatest(F.lit(1), F.col("g_median_chars"))))
    out = both.select(
        length.alias("length_gap"), gap("bubbles").alias("bubble_gap"), gap("lower_frac").alias("lower_gap"), gap("ends_punct").alias("punct_gap"), gap("emoji_per_reply").alias("emoji_gap"),
        gap("short_frac").alias("short_gap"), gap("caps_start").alias("caps_gap"), F.col("p_degenerate").alias("degenerate"), "vocab_overlap",
    )
    total = F.expr("0.25D * length_gap + bubble_gap + 2D * lower_gap + punct_gap + 0.5D * emoji_gap + short_gap + 5D * degenerate + 2D * (1D - vocab_overlap)")
    if incoming is not None:
        a, b = (initiative(rows, c, incoming) for c in (pred, gold))
        gaps = a.crossJoin(F.broadcast(b.select(*(F.col(c).alias(f"g_{c}") for c in b.columns)))).select(*(F.abs(F.col(c) - F.col(f"g_{c}")).alias(n) for c, n in (("question", "question_gap"), ("ack", "ack_gap"), ("new_words", "new_word_gap"))))
        out = out.crossJoin(F.broadcast(gaps))
        total = total + F.expr("3D * question_gap + 3D * ack_gap + 2D * new_word_gap")
    return out.withColumn("style_distance", total)


def summarize(rows: DataFrame) -> DataFrame:
    metrics = ("chrf", "rouge_l", "len_ratio", "copied", "exact", "score")
    return rows.agg(F.count("*").alias("n"), *(F.avg(F.col(m).cast("double")).alias(m) for m in metrics))


def by_recipient(rows: DataFrame, value: str = "score", peer: str = "peer", least: int = 2) -> DataFrame:
    """(peer, n, mean) of peers with enough rows."""
    return rows.groupBy(peer).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= least)


def modal_share(rows: DataFrame, text: str = "pred") -> DataFrame:
    """One row (text, share): the most common reply; ties to the smaller text."""
    each = rows.groupBy(text).agg(F.count("*").alias("n"))
    return each.agg(F.min_by(text, F.struct(-F.col("n"), text)).alias("text"), (F.max("n") / F.sum("n")).alias("share"))


def recipient_summary(rows: DataFrame, value: str = "score", text: str = "pred", peer: str = "peer", least: int = 2) -> DataFrame:
    """One row: peers, peer_score_range between the best and the worst mean of peers with ``least`` rows, and peer_mode_collapse, the share of peers whose most
    common reply is that of all rows.

    Null where fewer than two peers say something. Rows without a peer count for the most common reply only; ties go to the smaller text.
    """
    named = rows.where(T.text_or_empty(F.col(peer).cast("string")) != "")
    said = T.text_or_empty(F.col(text))
    means = by_recipient(named, value, peer, least).agg(F.count("*").alias("_known"), (F.max("mean") - F.min("mean")).alias("_range"))
    each = named.groupBy(peer, said.alias("_t")).agg(F.count("*").alias("_n")).groupBy(peer).agg(F.min_by("_t", F.struct(-F.col("_n"), "_t")).alias("_mode"))
    common = rows.groupBy(said.alias("_t")).agg(F.count("*").alias("_n")).agg(F.min_by("_t", F.struct(-F.col("_n"), "_t")).alias("_all"))
    same = each.crossJoin(F.broadcast(common)).agg(F.count("*").alias("peers"), F.avg(((F.col("_mode") == F.col("_all")) & (F.col("_all") != "")).cast("double")).alias("_same"))
    both = same.crossJoin(F.broadcast(means))  # one row each
    enough = (F.col("peers") >= 2) & (F.col("_known") >= 2)
    return both.select(F.when(F.col("peers") >= 2, F.col("peers")).alias("peers"), F.when(enough, F.col("_range")).alias("peer_score_range"), F.when(enough, F.col("_same")).alias("peer_mode_collapse"))


def zip_lists(rows: DataFrame, key: str, lists: Sequence[str]) -> DataFrame:
    """(key, place, each list's value there, error): lists of equal length side by side; lists of different lengths give one row that says so, and no values."""
    sizes = [F.size(F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))) for c in lists]
    equal = F.lit(True)
    for n in sizes[1:]:
        equal = equal & (n == sizes[0])
    told = F.concat(F.lit("lengths differ: "), F.concat_ws(", ", *(F.concat(F.lit(f"{c} "), n.cast("string")) for c, n in zip(lists, sizes, strict=True))))
    good = rows.where(equal).select(key, F.posexplode(F.arrays_zip(*lists)).alias("place", "_z"), F.lit(None).cast("string").alias("error"))
    bad = rows.where(~equal).select(key, F.lit(None).cast("int").alias("place"), *(F.lit(None).cast(rows.schema[c].dataType.elementType).alias(c) for c in lists), told.alias("error"))
    return good.select(key, "place", *(F.col(f"_z.{c}").alias(c) for c in lists), "error").unionByName(bad)


def by_turn_and_depth(rows: DataFrame, value: str, cap: int = 5) -> DataFrame:
    """(turn, depth, n, mean) over turns up to a cap, over depths, and over all: grouping sets."""
    capped = rows.withColumn("turn", F.least("turn", F.lit(cap)))
    return capped.groupingSets([["turn"], ["depth"], []], "turn", "depth").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def distinct_ngrams(rows: DataFrame, text: str, n: int = 2) -> DataFrame:
    """One row: different word n-grams over all of them."""
    words = rows.select(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "").alias("w"))
    grams = words.where(F.size("w") >= n).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("g"))
    return grams.agg((F.countDistinct("g") / F.count("*")).alias("distinct"))


def bootstrap(rows: DataFrame, value: str, key: str, rounds: int = BOOTSTRAP, seed: int = 0) -> DataFrame:
    """One row (mean, low, high): a percentile interval from Poisson resampling, which needs no global shuffle of rows.

    Each row counts a Poisson(1) number of times in each round, drawn by a hash of its key.
    """
    draws = rows.select(F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"), F.col(key).alias("k"))
    u = F.pmod(F.xxhash64(F.lit(seed), "round", "k"), F.lit(1_000_003)) / 1_000_003
    times = sum(((u >= c).cast("int") for c in _POISSON), F.lit(0))
    means = draws.withColumn("t", times).groupBy("round").agg((F.sum(F.col("v") * F.col("t")) / F.nullif(F.sum("t"), F.lit(0))).alias("m"))
    limits = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return rows.agg(F.avg(value).alias("mean")).crossJoin(F.broadcast(limits))


def paired_win_rate(rows: DataFrame, a: str, b: str, key: str, rounds: int = BOOTSTRAP, seed: int = 0) -> DataFrame:
    """One row (p): how often the resampled mean of a beats that of b, ties as halves."""
    diff = rows.withColumn("_d", F.col(a) - F.col(b))
    draws = diff.select("_d", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"), F.col(key).alias("k"))
    u = F.pmod(F.xxhash64(F.lit(seed), "round", "k"), F.lit(1_000_003)) / 1_000_003
    times = sum(((u >= c).cast("int") for c in _POISSON), F.lit(0))
    sums = draws.withColumn("t", times).groupBy("round").agg(F.sum(F.col("_d") * F.col("t")).alias("s"))
    return sums.agg(F.avg(F.when(F.col("s") > 0, 1.0).when(F.col("s") == 0, 0.5).otherwise(0.0)).alias("p"))


def pick_checkpoint(rows: DataFrame, incumbent: str) -> DataFrame:
    """The challenger (checkpoint, delta, p) with the largest gain that is large and sure enough, else the incumbent."""
    best = rows.where((F.col("delta") >= MIN_DELTA) & (F.col("p") >= MIN_P)).orderBy(F.desc("delta"), "checkpoint").limit(1).select("checkpoint", F.lit(0).alias("k"))
    stay = rows.sparkSession.createDataFrame([(incumbent, 1)], "checkpoint string, k int")
    return best.unionByName(stay).orderBy("k").limit(1).select("checkpoint")


def probes(rows: DataFrame, gold: str = "gold", key: str = "id") -> DataFrame:
    """(id, kind, text): each context with its gold reply, another context's, spam and a constant; the swap is half the rows away in order of the key (a number)."""
    ranked = ranked_rows(rows, [key]).withColumns({"_k": F.col("rank") - 1, "_n": F.col("units")})
    ranked = ranked.withColumn("_to", F.pmod(F.col("_k") + F.floor(F.col("_n") / 2), F.col("_n")))
    other = ranked.select(F.col("_k").alias("_to"), F.col(gold).alias("swapped"))
    out = ranked.join(other, "_to").withColumns({"spam": F.repeat(F.concat(F.col(gold), F.lit(" ")), F.lit(8)), "generic": F.lit("ok")})
    return out.withColumnRenamed(gold, "gold").select(key, "gold", "swapped", "spam", "generic").unpivot(key, ["gold", "swapped", "spam", "generic"], "kind", "text")


def promote(runs: DataFrame) -> DataFrame:
    """(setting, step, distance): among settings tried at two steps or more (else all), the one that reaches the least distance, at its best step."""
    steps = runs.groupBy("setting").agg(F.countDistinct("step").alias("steps"), F.min_by(F.struct("step", "distance"), F.struct("distance", "step")).alias("b"))
    return steps.orderBy((F.col("steps") < 2).cast("int"), "b.distance", "setting").limit(1).select("setting", "b.step", "b.distance")


def bench_rates(rows: DataFrame, text: str = "pred", ratio: str = "len_ratio") -> DataFrame:
    """One row: shares of replies with a placeholder, without text, too short and too long, the upper median of length ratios, and variety."""
    share = lambda c: F.avg(c.cast("double"))
    t = T.text_or_empty(F.col(text))
    rates = rows.agg(
        share(F.contains(t, F.lit("[")) & F.contains(t, F.lit("]"))).alias("placeholder_rate"), share(t == "").alias("blank_rate"),
        upper_median(f"`{ratio}`").alias("len_ratio_median"), share(F.col(ratio) < 0.5).alias("too_short_rate"), share(F.col(ratio) > 2.0).alias("too_long_rate"),
        (F.countDistinct(text) / F.count("*")).alias("unique_share"),
    )
    return rates.crossJoin(F.broadcast(modal_share(rows, text).select(F.col("share").alias("top1_share")))).crossJoin(F.broadcast(distinct_ngrams(rows, text).withColumnRenamed("distinct", "distinct_2")))


def relevance(rows: DataFrame, text: str = "pred", incoming: str = "prompt", key: str = "id") -> DataFrame:
    """One row: by how much replies resemble their own incoming message more than the next row's; the last row's next is the first."""
    ranked = ranked_rows(rows, [key])
    after = ranked.select((F.pmod(F.col("rank") - 2, F.col("units")) + 1).alias("rank"), F.col(incoming).alias("_next"))
    both = ranked.join(after, "rank")
    return both.agg((F.avg(S.chrf(text, incoming)) - F.avg(S.chrf(text, "_next"))).alias("relevance"))


def metric_accuracy(scored_probes: DataFrame, metric: str, key: str = "id", higher: bool = True) -> DataFrame:
    """(kind, wins, mean): how often the true reply beats each kind of bad one by a metric, and the mean of these shares."""
    good = scored_probes.where("kind = 'gold'").select(key, F.col(metric).alias("_gold"))
    bad = scored_probes.where("kind <> 'gold'").join(good, key).where(F.col(metric).isNotNull() & F.col("_gold").isNotNull())
    beats = F.col("_gold") > F.col(metric) if higher else F.col("_gold") < F.col(metric)
    wins = bad.groupBy("kind").agg(F.avg(beats.cast("double")).alias("wins"))
    return wins.crossJoin(F.broadcast(wins.agg(F.avg("wins").alias("mean"))))


def comparable_runs(log: DataFrame, runs: DataFrame, data_hash: str, split: str = "valid") -> DataFrame:
    """(adapter, setting, step, distance): scores on one dataset, by decoding setting; a score without a step is of the run's last (``runs``: adapter, iters)."""
    rows = log.where((F.col("data_hash") == data_hash) & (F.col("split") == split)).join(runs.select("adapter", "iters"), "adapter", "left")
    rows = rows.withColumn("step", F.coalesce(F.nullif("step", F.lit(0)), "iters")).where(F.col("step") > 0)
    setting = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("temp", "repetition_penalty", "retrieve_k")))
    return rows.withColumn("setting", setting).groupBy("adapter", "setting", "step").agg(F.max_by("distance", "ts").alias("distance"))
