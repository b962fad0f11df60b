"""Requests to labelling models and what comes back: request lines, injected calls, state of batches, checks of answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.model_output import strict_answer
from presswork.functions.text import label_action, normalize_ws, text_or_empty, to_bool

# fixed values: states of a batch, and the services' names for them
ACTIVE = ["validating", "in_progress", "finalizing", "submitted", "cancelling"]
STATUS = {"canceling": "cancelled", "ended": "completed"}
#: A word of a rationale: letters, digits and marks between them.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"


def prompt(template: str, **fields: Column) -> Column:
    """A text with {name} replaced by the named fields; missing ones read [missing]."""
    parts = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        parts.append(F.coalesce(F.nullif(normalize_ws(fields[piece]), F.lit("")), F.lit("[missing]")) if i % 2 else F.lit(piece))
    return F.concat(*parts)


def request_body(layout: str, custom_id: Column, system: Column, user: Column, model: str, max_tokens: int, temperature: float = 0.0) -> Column:
    """A request line as JSON in the layout of chat completions ("chat") or of messages ("messages").

    Newer chat models take another name for the token limit and no temperature.
    """
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    if layout == "messages":
        params = F.struct(
            F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), system.alias("system"), F.array(said("user", user)).alias("messages"), F.lit(float(temperature)).alias("temperature")
        )
        return F.to_json(F.struct(custom_id.alias("custom_id"), params.alias("params")))
    if layout != "chat":
        raise ValueError("the layout is chat or messages")
    newer = model.strip().lower().startswith("gpt-5")
    body = [
        F.lit(model).alias("model"), F.struct(F.lit("json_object").alias("type")).alias("response_format"), F.array(said("system", system), said("user", user)).alias("messages"),
        F.lit(max_tokens).alias("max_completion_tokens" if newer else "max_tokens"), *([] if newer else [F.lit(float(temperature)).alias("temperature")]),
    ]
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), F.struct(*body).alias("body")))


def batch_status(c: Column) -> Column:
    """A service's state of a batch in the one set of names."""
    s = F.lower(F.trim(c))
    return F.coalesce(*[F.when(s == k, v) for k, v in STATUS.items()], s)


def needs_submission(label: Column, state: Column) -> Column:
    """A row without a label whose batch is not under way."""
    return (normalize_ws(label) == "") & ~F.coalesce(batch_status(state).isin(ACTIVE), F.lit(False))


def hydrate(state: DataFrame, batches: DataFrame, results: DataFrame) -> DataFrame:
    """The state (custom_id, batch_id, headline_label, ...) after the batches' states and results have come.

    batches: (batch_id, status); results: (batch_id, custom_id, success, raw_text, error), joined on both ids. Rows of a
    batch under way take its state; of a failed one its state and an error; of a completed one their result: labelled,
    in error, or unchanged if none came. Rows without a batch stay as they are.
    """
    b = batches.select("batch_id", batch_status(F.col("status")).alias("__status")).dropDuplicates(["batch_id"])
    r = results.select("batch_id", "custom_id", F.col("success").alias("__ok"), "raw_text", F.col("error").alias("__error")).dropDuplicates(["batch_id", "custom_id"])
    j = state.join(b, "batch_id", "left").join(r, ["batch_id", "custom_id"], "left").withColumn("__a", strict_answer(F.col("raw_text")))
    done = F.col("__status") == "completed"
    hit, failed = done & F.col("__ok"), done & ~F.col("__ok")
    label = F.when(hit, F.coalesce("__a.label", F.lit("unsure"))).otherwise(F.col("headline_label"))
    error = F.when(hit, "").when(failed, F.left(normalize_ws(F.col("__error")), F.lit(500)))
    error = error.when(F.col("__status").isNotNull() & ~done & ~F.col("__status").isin(ACTIVE), F.concat(F.lit("batch_"), "__status"))
    new_state = F.when(hit, "hydrated").when(failed, "error").when(F.col("__status").isNotNull() & ~done, F.col("__status"))
    return j.select(
        "custom_id", "batch_id", label.alias("headline_label"), F.when(hit, F.coalesce("__a.confidence", F.lit(0.0))).alias("headline_confidence"),
        F.when(hit, F.coalesce("__a.error", F.lit(""))).alias("headline_parse_error"), F.coalesce(error, F.lit("")).alias("classification_error"),
        F.coalesce(new_state, F.lit("")).alias("batch_state"), F.when(normalize_ws(label) != "", label_action(label)).alias("final_action"),
    )


def relevance_probability(label: Column, confidence: Column, semantics: str = "auto") -> Column:
    """Probability of relevance from a label and its confidence, clamped to [0, 1], missing as 0.

    decision_confidence: of the decision, so a negative one is turned. relevance_probability: as it is. auto: turned where
    it contradicts the label.
    """
    c = F.least(F.greatest(F.coalesce(F.nanvl(confidence.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    if semantics == "relevance_probability":
        return c
    turn = ~label if semantics == "decision_confidence" else (label & (c < 0.5)) | (~label & (c > 0.5))
    return F.when(turn, 1.0 - c).otherwise(c)


def rationale_reason(rationale: Column, relevant: Column, spans: Column, aliases: list[str], least: int = 12, most: int = 24) -> Column:
    """Why a rationale is refused, empty if it is not: its words, its label in brackets, its linkage, the target's name,
    and evidence for a positive label; the first that fails."""
    t = F.trim(text_or_empty(rationale))
    n = F.regexp_count(t, F.lit(WORD))
    named = F.lit(False)
    for a in aliases:
        named = named | F.lower(t).contains(a.lower())
    # fixed values: the reason codes
    return (
        F.when(n < least, F.concat(F.lit("rationale_too_short:"), n.cast("string"), F.lit(f"<{least}")))
        .when(n > most, F.concat(F.lit("rationale_too_long:"), n.cast("string"), F.lit(f">{most}")))
        .when(~(t.contains("[") & t.contains("]")), "rationale_missing_domain_label")
        .when(~F.lower(t).contains("linkage:"), "rationale_missing_linkage_tag")
        .when(~named, "rationale_missing_target_reference")
        .when(F.coalesce(relevant, F.lit(False)) & (F.coalesce(F.size(spans), F.lit(0)) <= 0), "relevant_missing_evidence_span")
        .otherwise("")
    )


def complete_row(final_label: Column, votes: list[Column], errors: list[Column]) -> Column:
    """A row is complete if it is skipped, or has a final label and of each model a vote or an error."""
    every = F.lit(True)
    for v, e in zip(votes, errors):
        every = every & (to_bool(v).isNotNull() | (normalize_ws(e) != ""))
    label = normalize_ws(final_label)
    return (label == "skipped") | ((label != "") & every)


def fit_rows(expected: DataFrame, returned: DataFrame, batch: str, size: str, row: str) -> DataFrame:
    """(batch, row_no, value): a row for each of the `size` places of a batch; returned rows beyond it are dropped, places
    without one are NULL. returned: (batch, row_no from 1, value)."""
    places = expected.select(batch, F.explode(F.sequence(F.lit(1), F.col(size).cast("int"))).alias("row_no"))
    return places.join(returned.select(batch, "row_no", row), [batch, "row_no"], "left")


def degenerate_tail(rows: DataFrame, batch: str, place: str, confidence: Column, short: Column, kind: Column, tail: int = 100) -> DataFrame:
    """(batch, degenerate): whether a batch's last rows look made up: a fifth without confidence, or a fifth without text
    and four fifths of kind Other. Batches are bounded by a request's size."""
    last = F.max(place).over(_whole(batch)) - F.col(place) < tail
    t = rows.withColumn("__tail", last).where("__tail")
    share = lambda c: F.avg(F.coalesce(c, F.lit(True)).cast("int"))
    zero, blank, other = share(confidence == 0), share(normalize_ws(short) == ""), F.avg(F.coalesce(kind == "Other", F.lit(False)).cast("int"))
    return t.groupBy(batch).agg(((zero >= 0.2) | ((blank >= 0.2) & (other >= 0.8))).alias("degenerate"))


def _whole(batch: str):
    from pyspark.sql import Window

    return Window.partitionBy(batch)


def clean_description(c: Column, words: int = 5) -> Column:
    """A short description without commas, cut to its first words."""
    return F.array_join(F.slice(F.filter(F.split(normalize_ws(F.replace(text_or_empty(c), F.lit(","), F.lit("-"))), " "), lambda x: x != ""), 1, words), " ")


def call_each(rows: DataFrame, key: str, payload: str, call: Callable[[str], str], retries: int = 3, wait: float = 0.0, done: DataFrame | None = None) -> DataFrame:
    """(key, ok, text, error, attempts): an injected call for each row, tried again after an error with doubled waits.

    `done` has earlier answers in the same columns; only keys without a successful one are called, the others come out as
    they were. A call that fails every time is a row with its error. Each row's call is independent, so a lost task calls
    its own rows again.
    """
    todo = rows.select(key, payload)
    if done is not None:
        todo = todo.join(done.where("ok").select(key), key, "left_anti")
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, p in b.itertuples(index=False):
                text, error, n = None, None, 0
                while n < max(1, retries):
                    n += 1
                    try:
                        text, error = call(p), None
                        break
                    except Exception as e:  # noqa: BLE001 - whatever a service raises is the row's error
                        error = f"{type(e).__name__}: {e}"[:200]
                        if wait and n < retries:
                            time.sleep(wait * 2 ** (n - 1))
                out.append((k, error is None, text, error, n))
            yield pd.DataFrame(out, columns=[key, "ok", "text", "error", "attempts"])

    fresh = todo.mapInPandas(run, f"`{key}` {kind}, ok boolean, text string, error string, attempts int")
    return fresh if done is None else fresh.unionByName(done.where("ok").join(rows.select(key), key, "left_semi").select(fresh.columns))
