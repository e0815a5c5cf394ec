"""Training and evaluation metrics over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions.alignment import edit_distance_udf
from scriptloom.operators.sequences import linear_scan
from scriptloom.storage import written


def word_error_rate(pairs: DataFrame, by: list[str], ref: Column, hyp: Column) -> DataFrame:
    """(by, edits, ref_words, n_scored, wer) from token arrays: all edits over all
    reference words. NaN where there are no reference words."""
    scored = pairs.select(*by, edit_distance_udf(ref, hyp).alias("e"), F.size(ref).alias("w"))
    words = F.sum("w")
    return scored.groupBy(*by).agg(
        F.sum("e").alias("edits"), words.alias("ref_words"), F.count("*").alias("n_scored"), F.when(words > 0, F.sum("e") / words).otherwise(F.lit(float("nan"))).alias("wer")
    )


def loss_decomposition(positions: DataFrame, by: list[str], sample: str, pos: str, label: str, pred: str, loss: str) -> DataFrame:
    """Losses of first and later labelled positions. ``first_loss``: mean over samples;
    ``rest_loss``: mean of the samples' means; ``hit_loss`` and ``miss_loss``: means over
    all positions whose prediction was right or wrong. Null where nothing counts."""
    rows = positions.where(F.col(label).isNotNull())
    hit = F.col(label) == F.col(pred)
    per = rows.groupBy(*by, sample).agg(
        F.min_by(loss, pos).alias("first"),
        ((F.sum(loss) - F.min_by(loss, pos)) / F.nullif(F.count("*") - 1, F.lit(0))).alias("rest"),
        F.count("*").alias("n"),
        F.sum(F.when(hit, F.col(loss))).alias("hs"),
        F.count_if(hit).alias("hn"),
        F.sum(F.when(~hit, F.col(loss))).alias("ms"),
        F.count_if(~hit).alias("mn"),
    )
    return per.groupBy(*by).agg(
        F.avg("first").alias("first_loss"),
        F.avg("rest").alias("rest_loss"),
        (F.sum("hs") / F.nullif(F.sum("hn"), F.lit(0))).alias("hit_loss"),
        (F.sum("ms") / F.nullif(F.sum("mn"), F.lit(0))).alias("miss_loss"),
        F.sum("n").alias("n_positions"),
        F.sum("hn").alias("n_hits"),
        F.count("*").alias("n_samples"),
    )


def loss_decomposition_by_type(samples: DataFrame, labelled: str, types: DataFrame, keys: list[str], pred: str, loss: str) -> DataFrame:
    """As ``loss_decomposition`` without groups, where prediction and loss hang on ``keys`` alone
    (``types`` has one row for each) and the label is the last key. ``samples``: a row a
    sample; ``labelled``: its labelled positions in order, an array of structs of the keys.

    All sums are additive: a position adds its sample's weight to its type, so the exchange
    moves counts of types, which are summed before it, and no position."""
    rows = samples.select(F.col(labelled).alias("_l"), F.size(labelled).alias("_n")).where("_n > 0")
    at = rows.select("_n", F.posexplode("_l").alias("_i", "_k")).select("_n", "_i", "_k.*")
    first = F.col("_i") == 0
    share = F.when(first, F.lit(0.0)).otherwise(1 / F.nullif(F.col("_n") - 1, F.lit(0)))
    # sums over samples ride along: each sample has one first position
    counts = at.groupBy(*keys).agg(
        F.count("*").alias("_c"), F.count_if(first).alias("_f"), F.sum(share).alias("_w"), F.count_if(first & (F.col("_n") > 1)).alias("_m")
    )
    hit, weighted = F.col(keys[-1]) == F.col(pred), F.col(loss) * F.col("_c")

    def mean(total: Column, n: Column) -> Column:
        return F.sum(total) / F.nullif(F.sum(n), F.lit(0))

    return counts.join(types, keys).agg(
        mean(F.col(loss) * F.col("_f"), F.col("_f")).alias("first_loss"),
        (F.sum(F.col(loss) * F.col("_w")) / F.nullif(F.sum("_m"), F.lit(0))).alias("rest_loss"),
        mean(F.when(hit, weighted), F.when(hit, F.col("_c"))).alias("hit_loss"),
        mean(F.when(~hit, weighted), F.when(~hit, F.col("_c"))).alias("miss_loss"),
        F.coalesce(F.sum("_c"), F.lit(0)).alias("n_positions"),
        F.coalesce(F.sum(F.when(hit, F.col("_c"))), F.lit(0)).alias("n_hits"),
        F.coalesce(F.sum("_f"), F.lit(0)).alias("n_samples"),
    )


def slice_state(logits: Column, start: Column, label: Column) -> Column:
    """What a slice of a position's logits, from id ``start`` on, tells of its loss: the largest
    logit, its id, and relative to it the sums of e^x and x e^x; and the label's logit, if it
    lies here. Logits of minus infinity have no weight."""
    top = F.array_max(logits)
    none = top.isNull() | (top == float("-inf"))
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    weighted = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.when(x == float("-inf"), 0.0).otherwise(F.exp(x - top) * (x - top)))
    at = label - start
    here = F.when((at >= 0) & (at < F.size(logits)), F.get(logits, at.cast("int")))
    return F.struct(
        F.coalesce(top, F.lit(float("-inf"))).alias("top"), (start + F.array_position(logits, top) - 1).cast("long").alias("at"),
        F.when(none, 0.0).otherwise(total).alias("total"), F.when(none, 0.0).otherwise(weighted).alias("weighted"), here.cast("double").alias("label"),
    )


def merged_state(a: Column, b: Column) -> Column:
    """The state of two slices together; the order of merges does not matter. Of equal logits
    the smaller id is the prediction."""
    first = (a["top"] > b["top"]) | ((a["top"] == b["top"]) & (F.coalesce(a["at"] <= b["at"], b["at"].isNull())))
    top = F.greatest(a["top"], b["top"])

    def moved(s: Column) -> tuple[Column, Column]:
        gone, shift = s["total"] == 0, s["top"] - top
        scale = F.exp(shift)
        return F.when(gone, 0.0).otherwise(s["total"] * scale), F.when(gone, 0.0).otherwise(scale * (s["weighted"] + s["total"] * shift))

    (ta, wa), (tb, wb) = moved(a), moved(b)
    return F.struct(
        top.alias("top"), F.when(first, a["at"]).otherwise(b["at"]).alias("at"), (ta + tb).alias("total"), (wa + wb).alias("weighted"), F.coalesce(a["label"], b["label"]).alias("label")
    )


def sliced_losses(slices: DataFrame, by: list[str], start: str, logits: str, label: str) -> DataFrame:
    """(by, loss, pred, entropy) of positions whose logits come as slices (by, start, logits,
    label) of any lengths, in any order, so that no row holds a whole vocabulary. Only the
    slices' states, five numbers each, are exchanged. A label outside all slices has no
    loss."""
    states = slices.select(*by, slice_state(F.col(logits).cast("array<double>"), F.col(start).cast("long"), F.col(label).cast("long")).alias("s"))
    lists = states.groupBy(*by).agg(F.collect_list("s").alias("l"))
    one = lists.select(*by, F.aggregate(F.slice("l", F.lit(2), F.size("l")), F.element_at("l", 1), merged_state).alias("s"))
    norm = F.log("s.total")
    return one.select(*by, (norm + F.col("s.top") - F.col("s.label")).alias("loss"), F.col("s.at").cast("int").alias("pred"), (norm - F.col("s.weighted") / F.col("s.total")).alias("entropy"))


def token_budget(micros: DataFrame, by: list[str], n: str) -> DataFrame:
    """Labelled tokens of a window: mean of its micro-batches and total."""
    return micros.groupBy(*by).agg((F.sum(n) / F.greatest(F.count("*"), F.lit(1))).alias("mean_tokens"), F.sum(n).alias("total_tokens"))


def normalized_entropy(rows: DataFrame, by: list[str], entropy: str, vocabulary: int) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(entropy) / F.count(entropy) / F.log(F.lit(vocabulary))).alias("entropy"))


def mean_of_batch_means(rows: DataFrame, by: list[str], batch: str, value: str) -> DataFrame:
    return rows.groupBy(*by, batch).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.avg("m").alias("mean"))


def top_votes(votes: DataFrame, token: str, order: str, k: int, micros: int, sep: str | int) -> DataFrame:
    """(token, votes, per_micro, sep_share): the k tokens with most votes, of equals the
    one first seen; shares are over micro-batches, so they can exceed one."""
    # written, for sums and ranks both read them
    counts = written(votes.groupBy(token).agg(F.count("*").alias("votes"), F.min(order).alias("first_seen")))
    all_ = counts.agg(F.sum("votes").alias("every"), F.coalesce(F.sum(F.when(F.col(token) == sep, F.col("votes"))), F.lit(0)).alias("of_sep"))
    best = counts.orderBy(F.desc("votes"), "first_seen").limit(k)
    return best.join(F.broadcast(all_)).select(token, "votes", (F.col("votes") / micros).alias("per_micro"), (F.col("of_sep") / F.col("every")).alias("sep_share"))


def norms(rows: DataFrame, component: str, value: Column) -> DataFrame:
    """L2 norm of each component; ``value`` may be an array."""
    return rows.groupBy(component).agg(F.sqrt(F.sum(value * value)).alias("norm"))


def norm_ratio(of: Column, to: Column) -> Column:
    return of / F.greatest(to, F.lit(1e-12))


def cumulative(rows: DataFrame, group: list[str], order: str, value: str, name: str) -> DataFrame:
    """Running sums; nulls add nothing. A group of any size is split over tasks."""
    return linear_scan(rows, value, 1.0, 1.0, group, [order], name)


def flushed(log: DataFrame, step: str, phase: str, value: str, period: int, always: str) -> DataFrame:
    """(phase, step, n, mean) of the steps that emit: every ``period``-th, and all of the
    phase ``always``. Windows reset at each step, so a value covers that step alone; the
    filter is on plain columns and reaches the scan."""
    emits = (F.col(step) % period == 0) | (F.col(phase) == always)
    return log.where(emits).groupBy(phase, step).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def collected(log: DataFrame, families: dict[str, tuple[str, tuple[str, ...], int]], always: str = "eval") -> DataFrame:
    """(phase, step, name, value): all metrics of a log (step, phase, name, value), each folded
    as its family says. ``families``: name to (mean, sum, max, last or norm; phases it
    belongs to; period). A value shows at every ``period``-th step, in the phase
    ``always`` at each. Windows are single steps. ``last`` goes by the column ``ts``.
    Routes are one expression, so all families fold in one pass and one exchange."""
    kinds = F.create_map(*[F.lit(x) for name, (kind, _, _) in families.items() for x in (name, kind)])
    routed = F.lit(False)
    for name, (_, phases, period) in families.items():
        due = (F.col("phase") == always) | (F.col("step") % period == 0)
        routed = routed | ((F.col("name") == name) & F.col("phase").isin(*phases) & due)
    value, kind = F.col("value"), F.col("kind")
    sums = log.where(routed).groupBy("phase", "step", "name").agg(
        F.avg(value).alias("mean"), F.sum(value).alias("sum"), F.max(value).alias("max"), F.max_by(value, "ts").alias("last"), F.sqrt(F.sum(value * value)).alias("norm")
    )
    chosen = F.lit(None).cast("double")
    for how in ("mean", "sum", "max", "last", "norm"):
        chosen = F.when(kind == how, F.col(how)).otherwise(chosen)
    return sums.withColumn("kind", kinds[F.col("name")]).select("phase", "step", "name", chosen.alias("value"))


def gaps(train: DataFrame, evaluation: DataFrame, step: str, value: str) -> DataFrame:
    """(step, train, eval, gap): eval less train, null unless both are there."""
    a = train.select(step, F.col(value).alias("train"))
    b = evaluation.select(step, F.col(value).alias("eval"))
    return a.join(b, step, "full_outer").withColumn("gap", F.col("eval") - F.col("train"))


def stage_exit(rule: str, step: Column, epoch: Column, first_token: Column, eval_loss: Column, threshold: float, min_steps: int) -> Column:
    """Whether a stage ends; a missing metric never ends one."""
    below = {"first_token_below": first_token, "eval_loss_below": eval_loss}
    if rule in below:
        fires = (below[rule] < threshold) & (step >= min_steps)
    elif rule == "max_steps":
        fires = step >= int(threshold)
    elif rule == "epochs":
        fires = (epoch >= threshold) & (step >= min_steps)
    elif rule == "never":
        fires = F.lit(False)
    else:
        raise ValueError(f"unknown exit rule {rule!r}")
    return F.coalesce(fires, F.lit(False))


def first_firing(log: DataFrame, step: str, fires: Column) -> DataFrame:
    return log.where(fires).agg(F.min(step).alias("step"))


def scores_words(enabled: Column, step: Column, period: int, first_token: Column, threshold: float) -> Column:
    """Whether a step is ready for a word-error pass."""
    return F.coalesce(enabled & (step % period == 0) & (first_token < threshold), F.lit(False))


# Levels of the console's warnings.
SEP_SHARE, ENTROPY_HIGH, ENTROPY_LOW, LOGIT_HIGH, NORM_RATIO = 0.5, 0.85, 0.15, 50, 10


def warnings(first: Column, rest: Column, sep_share: Column, entropy: Column, max_logit: Column, ratio: Column) -> Column:
    """Names of the conditions that hold."""
    found = F.array(
        F.when(first <= rest, "collapse"),
        F.when(sep_share > SEP_SHARE, "end_collapse"),
        F.when(entropy > ENTROPY_HIGH, "entropy_high"),
        F.when(entropy < ENTROPY_LOW, "entropy_low"),
        F.when(max_logit > LOGIT_HIGH, "logits_high"),
        F.when(ratio > NORM_RATIO, "norms_apart"),
    )
    return F.filter(found, lambda x: x.isNotNull())
