"""Labels and labelling runs: joins, relabelling, validation, retries, reports, costs.

Tables
  utterances  key, chapter, unformatted, attempts, formatted?, validation?, failure?
  requests    custom_id, kind, chapter, target_ids, context_ids, state, stop_reason?,
              model?, usage struct?
  responses   custom_id, text
  labels      key, unformatted, formatted, validation? (missing means ok)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions.alignment import validates
from scriptloom.functions.responses import parse_response
from scriptloom.functions.text import is_wildcard, max_tokens, minimal_divergence, normalize, payload_chars, tokens
from scriptloom.operators.sequences import valid_neighbours
from scriptloom.operators.sets import config_changes
from scriptloom.storage import bounded, with_position, written

# Fixed values.
IN_FLIGHT = ("pending", "submitted")
SUFFIXES = ("s", "'s", "'ll", "'re", "'ve", "'d", "'m", "n't")
#: The most frequent tokens that every worker holds, and the length of the longest.
COMMON_TOKENS, COMMON_CHARS = 100_000, 40
BATCH_DISCOUNT, CACHE_WRITE, CACHE_READ, ATTESTED = 0.5, 1.25, 0.10, 2


def validation_of(column: str = "validation") -> Column:
    return F.coalesce(F.col(column), F.lit("ok"))


def latest_labels(labels: DataFrame, order: str) -> DataFrame:
    """One label a key: the last in file order."""
    others = [c for c in labels.columns if c not in ("key", order)]
    last = F.max_by(F.struct(*others), order)
    return labels.groupBy("key").agg(last.alias("l")).select("key", "l.*")


def label_verdicts(labels: DataFrame) -> DataFrame:
    """(key, failed, formatted): a key that failed anywhere has failed."""
    ok = validation_of() == "ok"
    return labels.groupBy("key").agg(F.bool_or(~ok).alias("failed"), F.max(F.when(ok, F.col("formatted"))).alias("new_formatted"), F.max(F.when(ok, F.col("unformatted"))).alias("new_unformatted"))


def labelled(utterances: DataFrame, labels: DataFrame) -> DataFrame:
    """Utterances with an accepted label."""
    return utterances.join(labels.where(validation_of() == "ok"), "key")


def classified(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Samples with ``class``: kept, failed or unlabelled."""
    joined = samples.join(label_verdicts(labels), "key", "left")
    kind = F.when(F.col("failed").isNull(), "unlabelled").when(F.col("failed"), "failed").otherwise("kept")
    return joined.withColumn("class", kind)


def relabelled(manifest: DataFrame, labels: DataFrame, drop_unlabelled: bool = False) -> DataFrame:
    """The manifest with new texts for kept rows; failed rows go. Unlabelled rows go if
    allowed, else reading one raises. Other columns pass through."""
    rows = classified(manifest, labels).where(F.col("class") != "failed")
    if drop_unlabelled:
        rows = rows.where(F.col("class") == "kept")
    else:
        missing = F.raise_error(F.concat(F.lit("no label for "), F.col("key").cast("string")))
        rows = rows.where(F.when(F.col("class") == "kept", True).otherwise(missing.cast("boolean")))
    new = {"formatted": F.col("new_formatted"), "unformatted": F.col("new_unformatted")}
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in manifest.columns])


def relabel_counts(samples: DataFrame, labels: DataFrame, *by: str) -> DataFrame:
    """Counters of a relabelling run, mergeable by sum; two text members a kept sample."""
    kept = F.count_if(F.col("class") == "kept")
    return (
        classified(samples, labels)
        .groupBy(*by)
        .agg(
            F.count("*").alias("sample_total"),
            kept.alias("sample_kept"),
            F.count_if(F.col("class") == "failed").alias("sample_failed"),
            F.count_if(F.col("class") == "unlabelled").alias("sample_unlabelled"),
            (kept * 2).alias("member_relabelled"),
        )
    )


def status_histogram(utterances: DataFrame) -> DataFrame:
    """(status, n, share): failed ones by kind."""
    kind = F.coalesce("failure", F.lit("unvalidated"))
    status = F.when(F.col("validation") == "failed", F.concat(F.lit("failed:"), kind)).otherwise(F.coalesce("validation", F.lit("pending")))
    counts = utterances.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("status", "n", (F.col("n") / F.col("total")).alias("share"))


def worst(utterances: DataFrame, by: str, n: int) -> DataFrame:
    """The n values of ``by`` with most rows that are not ok, and the number of the others."""
    counts = utterances.where(validation_of() != "ok").groupBy(by).agg(F.count("*").alias("n"))
    groups = counts.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return counts.orderBy(F.desc("n"), by).limit(n).join(F.broadcast(groups))


def failure_counts(utterances: DataFrame, by: str = "failure") -> DataFrame:
    """(by, n) of the utterances that are not ok; a failure without a kind is ``unvalidated``."""
    failed = utterances.where(~F.col("validation").eqNullSafe("ok"))
    value = F.coalesce(by, F.lit("unvalidated")) if by == "failure" else F.col(by)
    return failed.groupBy(value.alias(by)).agg(F.count("*").alias("n"))


def new_requests(prepared: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Insert-if-absent: rows whose key is not there yet."""
    return prepared.join(existing.select(key).distinct(), key, "left_anti")


def prepared(run: dict | None, config: dict, utterances: DataFrame, requests: DataFrame, existing: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """All utterances and requests of a run after new ones (``key``, ``custom_id``) joined
    those that exist. Preparing twice changes nothing. A run with another configuration
    raises, for its submitted requests would no longer fit."""
    if changed := config_changes(run or config, config, list(config)):
        raise ValueError(f"prepared before with other settings: {', '.join(changed)}")
    if existing is None:
        return utterances, requests
    pairs = zip(existing, (utterances, requests), ("key", "custom_id"), strict=True)
    return tuple(old.unionByName(new_requests(new, old, key)) for old, new, key in pairs)


def report_order(triaged_rows: DataFrame) -> DataFrame:
    """Triaged rows with their ``position`` in a report: rows that need no judgement (no
    tag) first, then the model's edits, then probable defects of the reference; by key."""
    bucket = F.when(F.col("tag").isNull(), 0).when(F.col("tag") == "model-edit", 1).otherwise(2)
    return with_position(triaged_rows.withColumn("bucket", bucket), "bucket", "key")


def collected(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests with their results, and results of unknown requests (``known`` false)."""
    known = requests.select("custom_id", F.lit(True).alias("known"))
    return results.join(known, "custom_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def usage_of(usage: Column) -> list[Column]:
    names = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    return [F.coalesce(usage[n], F.lit(0)).cast("long").alias(n) for n in names]


def judged_targets(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(key, custom_id, formatted, failure, extra_ids) for each target of each finished
    request, before alignment."""
    done = requests.where(~F.col("state").isin(*IN_FLIGHT)).join(responses, "custom_id", "left")
    parsed = done.withColumn("parsed", parse_response(F.coalesce("text", F.lit(""))))
    got = F.col("text").isNotNull() & (F.col("state") == "succeeded")
    rows = parsed.select("custom_id", "stop_reason", "parsed", got.alias("got"), "target_ids", F.explode("target_ids").alias("key"))
    failure = (
        F.when(~F.col("got"), "no_response")
        .when(F.col("parsed").isNull(), F.when(F.col("stop_reason") == "max_tokens", "truncated").otherwise("unparseable"))
        .when(F.col("parsed")[F.col("key")].isNull(), "missing")
    )
    extra = F.array_sort(F.array_except(F.coalesce(F.map_keys("parsed"), F.array().cast("array<string>")), "target_ids"))
    return rows.select("key", "custom_id", F.when(F.col("got"), F.col("parsed")[F.col("key")]).alias("formatted"), failure.alias("failure"), extra.alias("extra_ids"))


def validated(utterances: DataFrame, requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Utterances with new formatted, validation and failure. Of several finished requests
    the one with the last id decides; an aligned or misaligned text is stored, and stays
    when a later request brings none."""
    each = judged_targets(requests, responses).join(utterances.select("key", F.col("unformatted").alias("_ref")), "key")
    each = each.withColumn("failure", F.coalesce("failure", F.when(~validates(F.col("formatted"), F.col("_ref")), "alignment")))
    last = each.groupBy("key").agg(
        F.max_by(F.struct("failure", "custom_id"), "custom_id").alias("v"),
        F.max_by("formatted", F.when(F.col("formatted").isNotNull(), F.col("custom_id"))).alias("_formatted"),
    )
    joined = utterances.join(last, "key", "left")
    judged = F.col("v").isNotNull()
    new = {
        "formatted": F.coalesce("_formatted", "formatted"),
        "validation": F.when(judged, F.when(F.col("v.failure").isNull(), "ok").otherwise("failed")).otherwise(F.col("validation")),
        "failure": F.when(judged, F.col("v.failure")).otherwise(F.col("failure")),
    }
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in utterances.columns])


def retry_plan(utterances: DataFrame, requests: DataFrame, most: int) -> DataFrame:
    """Failed utterances with ``plan``: unsubmitted, in_flight, capped or queued, tested in
    this order; a submitted request outweighs a pending one."""
    waiting = requests.where(F.col("state").isin(*IN_FLIGHT)).select(F.explode("target_ids").alias("key"), "state")
    waiting = waiting.groupBy("key").agg(F.bool_or(F.col("state") == "submitted").alias("submitted"))
    plan = (
        F.when(~F.col("submitted"), "unsubmitted").when(F.col("submitted"), "in_flight").when(F.col("attempts") >= most, "capped").otherwise("queued")
    )
    return utterances.where(F.col("validation") == "failed").join(waiting, "key", "left").withColumn("plan", plan).drop("submitted")


def retry_requests(utterances: DataFrame, requests: DataFrame, most: int) -> DataFrame:
    """A request for each queued utterance: that one target, its nearest valid neighbours
    as context, and a budget that grows with the attempts."""
    near = valid_neighbours(utterances, "chapter", "key", "key", F.col("validation") == "ok").select("chapter", "key", "neighbours")
    queued = retry_plan(utterances, requests, most).where(F.col("plan") == "queued")
    attempt = F.col("attempts") + 1
    chars = payload_chars(F.array(F.struct(F.col("key"), F.col("unformatted").alias("text"))))
    return queued.join(near, ["chapter", "key"]).select(
        F.concat(F.lit("retry_"), "key", F.lit("_a"), attempt.cast("string")).alias("custom_id"),
        F.lit("retry").alias("kind"),
        "chapter",
        F.array("key").alias("target_ids"),
        F.col("neighbours").alias("context_ids"),
        max_tokens(chars, attempt).alias("max_tokens"),
        F.lit("pending").alias("state"),
    )


def finalized(utterances: DataFrame) -> DataFrame:
    """Labels to ship, one for every utterance: without formatted text the plain one."""
    return utterances.select(
        "key",
        "unformatted",
        F.coalesce(F.nullif("formatted", F.lit("")), "unformatted").alias("formatted"),
        F.when(F.col("validation") == "ok", "ok").otherwise("failed").alias("validation"),
        "attempts",
    )


def vouched(token: Column, in_dictionary: Column, base_in_dictionary: Column, frequency: Column) -> Column:
    """Whether something independent attests a reference token."""
    return (token == "") | is_wildcard(token) | F.coalesce(in_dictionary, F.lit(False)) | F.coalesce(base_in_dictionary, F.lit(False)) | (F.coalesce(frequency, F.lit(0)) >= ATTESTED)


def triaged(failed: DataFrame, dictionary: DataFrame, frequency: DataFrame) -> DataFrame:
    """Misaligned rows (key, unformatted, formatted) with the trimmed edit, the reference
    tokens that nothing vouches for, and ``tag``."""
    edit = minimal_divergence(tokens(normalize(F.col("unformatted"))), tokens(normalize(F.col("formatted"))))
    rows, frequency = written(failed.select("key", edit.alias("edit"))), written(frequency.select("token", "df"))
    # frequent tokens, which fill most of every text, go in place and are never exchanged
    common = frequency.where((F.col("df") >= ATTESTED) & (F.length("token") <= COMMON_CHARS)).orderBy(F.desc("df"), "token").limit(COMMON_TOKENS)
    each = rows.select("key", F.explode(F.array_distinct("edit.ref")).alias("token")).join(F.broadcast(common.select("token")), "token", "left_anti")
    known = bounded(dictionary.select("word").distinct().withColumn("known", F.lit(True)))
    bases = F.array(*[F.when(F.endswith("token", F.lit(s)), F.expr(f"left(token, length(token) - {len(s)})")) for s in SUFFIXES])
    stems = each.select("key", "token", F.explode(F.filter(bases, lambda b: b.isNotNull())).alias("word")).join(known, "word").groupBy("key", "token").agg(F.max("known").alias("stem"))
    checked = (
        each.join(known.withColumnRenamed("word", "token"), "token", "left")
        .join(stems, ["key", "token"], "left")
        .join(frequency, "token", "left")
        .where(~vouched(F.col("token"), F.col("known"), F.col("stem"), F.col("df")))
    )
    suspects = checked.groupBy("key").agg(F.array_sort(F.collect_list("token")).alias("suspects"))
    joined = rows.join(suspects, "key", "left")
    tag = F.when(F.col("suspects").isNotNull(), "probable-reference-defect").otherwise("model-edit")
    return joined.select("key", F.array_join("edit.ref", " ").alias("ref_edit"), F.array_join("edit.hyp", " ").alias("hyp_edit"), tag.alias("tag"), F.array_join(F.coalesce("suspects", F.array()), ",").alias("suspects"))


def costs(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage and cost a model, with a total row (model null). An unknown price makes its
    row and the total unpriced. ``requests``: model, input_tokens, output_tokens,
    cache_write, cache_read; ``prices``: model, input_price, output_price a million."""
    sums = requests.groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(
        F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_write", "cache_read")]
    )
    paid = (F.col("input_tokens") + F.col("cache_write") * CACHE_WRITE + F.col("cache_read") * CACHE_READ) * F.col("input_price") + F.col("output_tokens") * F.col("output_price")
    priced = sums.join(bounded(prices), "model", "left").withColumn("cost", paid * BATCH_DISCOUNT / 1e6)
    every = ("requests", "input_tokens", "output_tokens", "cache_write", "cache_read")
    cost = F.when(F.count("cost") == F.count("*"), F.sum("cost"))
    return priced.rollup("model").agg(*[F.sum(c).alias(c) for c in every], cost.alias("cost"))
