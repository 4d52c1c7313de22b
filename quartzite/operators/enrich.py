"""Batch enrichment of reviews: rules and corruption gates, language, sentiment by injected scorers, reuse and retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzite.operators.quality import violations

Scorer = Callable[[list[str]], list[str]]
IDENTITY = ["review_id", "content"]


def normalize_reviews(df: DataFrame) -> DataFrame:
    """Review records of a batch (batch_id, position, ...) with `issues`: the names of fields that don't hold."""
    bad = {"external_review_id": F.coalesce(F.trim("external_review_id"), F.lit("")) == "", "score": ~F.coalesce(F.col("score").between(1, 5), F.lit(False)), "thumbs_up_count": F.coalesce(F.col("thumbs_up_count") < 0, F.lit(True)), "content": F.col("content").isNull(), "source_at": F.col("source_at").isNull()}
    return df.withColumn("issues", F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in bad.items()))))


def batch_diagnostics(df: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Received, accepted and skipped records of each batch; with requested (batch_id, requested) also how many were asked for, and batches of which nothing came."""
    ok = F.size("issues") == 0
    if requested is not None:
        found = requested.join(batch_diagnostics(df), "batch_id", "left")
        return found.select("batch_id", "requested", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("received", "accepted", "skipped")))
    return df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("received"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("skipped"))


def record_issues(df: DataFrame) -> DataFrame:
    return violations(df.withColumn("_r", F.concat_ws("/", "batch_id", "position")), "_r", [(name, F.array_contains("issues", name), f"{name} is invalid") for name in ("external_review_id", "score", "thumbs_up_count", "content", "source_at")])


def gate_batches(df: DataFrame, percent: int = 5) -> DataFrame:
    """Accepted records of batches that may be trusted: one with none accepted, or more than `percent` in a hundred skipped, goes whole."""
    d = batch_diagnostics(df)
    trusted = d.where((F.col("accepted") > 0) & (F.col("skipped") * 100 <= F.col("received") * percent)).select("batch_id")
    return df.where(F.size("issues") == 0).join(trusted, "batch_id", "left_semi")


def letters(text: str) -> Column:
    return F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}]", ""))


def detect_language(df: DataFrame, detect: Callable[[list[str]], list[tuple[str, float]]], supported: Sequence[str] = ("en", "fa"), least: float = 0.85, text: str = "content") -> DataFrame:
    """Adds sentiment_language and language_status: `ok`, or why a text is skipped. detect gives a language and its confidence for each text, some texts at a time."""

    @F.pandas_udf("language string, confidence double")
    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(detect(texts.fillna("").tolist()), columns=["language", "confidence"])

    d = df.withColumn("_l", F.when(letters(text) >= 3, told(F.col(text))))
    status = F.when(F.col("_l").isNull(), "too_short").when(F.col("_l.confidence") < least, "low_confidence").when(~F.col("_l.language").isin(*supported), "unsupported").otherwise("ok")
    return d.withColumns({"language_status": status, "sentiment_language": F.when(status == "ok", F.col("_l.language"))}).drop("_l")


def score_sentiment(df: DataFrame, scorers: dict[str, Scorer], text: str = "content", batch: int = 32) -> DataFrame:
    """Adds sentiment_label and sentiment_error by the scorer of each row's sentiment_language; if a batch fails, its items are scored one by one."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, sentiment_label string, sentiment_error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            labels, errors = [None] * len(frame), [None] * len(frame)
            languages, texts = frame["sentiment_language"].tolist(), frame[text].tolist()
            for language, scorer in scorers.items():
                at = [i for i, x in enumerate(languages) if x == language]
                for k in range(0, len(at), batch):
                    part = at[k : k + batch]
                    try:
                        for i, label in zip(part, scorer([texts[i] for i in part]), strict=True):
                            labels[i] = label
                    except Exception:
                        for i in part:
                            try:
                                labels[i] = scorer([texts[i]])[0]
                            except Exception as e:
                                errors[i] = f"{type(e).__name__}: {e}"[:500]
            yield frame.assign(sentiment_label=labels, sentiment_error=errors)

    return df.mapInPandas(run, schema)


def identities(df: DataFrame) -> DataFrame:
    """Each distinct review and content once: what is scored."""
    return df.select(*IDENTITY).distinct()


def same_identity(a: str, b: str) -> Column:
    """Equal review and content, where two missing contents are equal too."""
    return (F.col(f"{a}.review_id") == F.col(f"{b}.review_id")) & F.col(f"{a}.content").eqNullSafe(F.col(f"{b}.content"))


def reuse(pending: DataFrame, history: DataFrame) -> DataFrame:
    """Pending rows with an earlier outcome of the same identity, if there is one: done before skipped, then the newest."""
    w = Window.partitionBy(*IDENTITY).orderBy((F.col("sentiment_status") == "done").desc(), F.desc_nulls_last("sentiment_processed_at"), "crawl_task_id")
    best = history.where(F.col("sentiment_status").isin("done", "skipped")).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    best = best.select("review_id", "content", F.col("sentiment_status").alias("reused_status"), F.col("sentiment_label").alias("reused_label"), F.col("sentiment_language").alias("reused_language"))
    return pending.alias("p").join(best.alias("h"), same_identity("p", "h"), "left").select("p.*", "reused_status", "reused_label", "reused_language")


def apply_results(obs: DataFrame, results: DataFrame) -> DataFrame:
    """Writes results (review_id, content, new_status, new_label, new_language) to rows that are still pending."""
    d = obs.alias("o").join(results.alias("r"), same_identity("o", "r"), "left").select("o.*", "new_status", "new_label", "new_language")
    hit = (F.col("sentiment_status") == "pending") & F.col("new_status").isNotNull()
    return d.withColumns({c: F.when(hit, F.col(n)).otherwise(F.col(c)) for c, n in (("sentiment_label", "new_label"), ("sentiment_language", "new_language"), ("sentiment_status", "new_status"))}).drop("new_status", "new_label", "new_language")


def record_failures(obs: DataFrame, failed: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Counts an attempt for failed identities; at the last the row has failed, before it stays pending."""
    d = obs.alias("o").join(failed.select(*IDENTITY).distinct().withColumn("_f", F.lit(True)).alias("f"), same_identity("o", "f"), "left").select("o.*", "_f")
    hit = (F.col("sentiment_status") == "pending") & F.coalesce("_f", F.lit(False))
    tries = F.col("sentiment_attempt_count") + hit.cast("int")
    return d.withColumns({"sentiment_status": F.when(hit & (tries >= max_attempts), "failed").otherwise(F.col("sentiment_status")), "sentiment_attempt_count": tries}).drop("_f")


def run_stats(pending: DataFrame, after: DataFrame, seconds: Column) -> DataFrame:
    """ENR-10: the eight counters of a run, in one row, from its pending rows (as of reuse()) and the same rows after it."""
    fresh = F.when(F.col("reused_status").isNull(), F.struct(*IDENTITY))
    before = pending.agg(F.count(F.lit(1)).alias("pending_observations"), F.count("reused_status").alias("reused_results"), F.count_distinct(fresh).alias("newly_analyzed_texts"))
    state = {"done_observations": "done", "skipped_observations": "skipped", "failed_observations": "failed", "retry_pending_observations": "pending"}
    now = after.agg(*(F.count_if(F.col("sentiment_status") == s).alias(name) for name, s in state.items()))
    return before.crossJoin(F.broadcast(now)).withColumn("duration_seconds", seconds)
