"""Reading the JSON answers of labelling models."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = ["relevant", "irrelevant", "unsure"]


def strict_answer(raw: Column) -> Column:
    """struct(label, confidence, rationale, error) of a strict answer.

    The outermost braces are parsed; the label must be one of LABELS, the confidence a number (or its text), clamped to
    [0, 1]; the rationale is cut at 280 characters. Errors: empty_response, invalid_json, invalid_label,
    invalid_confidence.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    doc = F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    label = F.lower(F.trim(F.try_variant_get(doc, "$.label", "string")))
    confidence = F.try_variant_get(doc, "$.confidence", "double")
    rationale = F.left(F.coalesce(F.try_variant_get(doc, "$.rationale", "string"), F.lit("")), F.lit(280))
    error = (
        F.when(text == "", "empty_response")
        .when(doc.isNull(), "invalid_json")
        .when(~F.coalesce(label.isin(LABELS), F.lit(False)), "invalid_label")
        .when(confidence.isNull(), "invalid_confidence")
    )
    ok = error.isNull()
    clamped = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))
    return F.struct(F.when(ok, label).alias("label"), F.when(ok, clamped).alias("confidence"), F.when(ok, rationale).alias("rationale"), error.alias("error"))


def repair_json(raw: str | None) -> dict | None:
    """A dictionary from an answer with fences, prose, single quotes, trailing commas or missing braces; else None."""
    if not raw or not raw.strip():
        return None
    text = re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", raw.strip())
    at = text.find("{")
    if at < 0:
        return None
    body = text[at : text.rfind("}") + 1] if "}" in text else text[at:]
    tries = [body, re.sub(r",\s*([}\]])", r"\1", body), body + "}" * max(0, body.count("{") - body.count("}"))]
    for t in tries:
        for read in (json.loads, ast.literal_eval):
            try:
                got = read(t)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue
            if isinstance(got, dict):
                return got
    return None


def stated_answer(raw: str | None) -> dict | None:
    """What an answer that is no JSON states: its relevance, and confidence, rationale and quoted spans where they are
    given; None without a relevance."""
    text = raw or ""
    value = lambda name, form: re.search(rf"(?is)[\"']?\b{name}\b[\"']?\s*[:=]\s*{form}", text)
    relevant = value("relevant", r"[\"']?(true|false|yes|no)\b")
    if relevant is None:
        return None
    out: dict = {"relevant": relevant.group(1).lower() in ("true", "yes"), "confidence": 0.0, "rationale": "", "evidence_spans": []}
    if number := value("confidence", r"[\"']?([01](?:\.\d+)?|\.\d+)"):
        out["confidence"] = min(1.0, max(0.0, float(number.group(1))))
    if said := value("rationale", r"(?:\"([^\"]*)\"|'([^']*)'|([^,\n\]}]+))"):
        out["rationale"] = " ".join(next(x for x in said.groups() if x is not None).split())
    if spans := value("evidence_spans?", r"\[(.*?)\]"):
        out["evidence_spans"] = [" ".join(x.split()) for x in re.findall(r"\"([^\"]+)\"|'([^']+)'", spans.group(1)) for x in x if x]
    return out


@F.pandas_udf(T.StringType())
def repaired_json(raw: pd.Series) -> pd.Series:
    def one(x):
        got = repair_json(x if isinstance(x, str) else None) or stated_answer(x if isinstance(x, str) else None)
        return None if got is None else json.dumps(got, sort_keys=True, default=str)

    return raw.map(one)
