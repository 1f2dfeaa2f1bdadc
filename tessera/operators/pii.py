"""Detection, masking, audit and threshold tuning of personal data.

Counts, flags, single-type redaction and whole-value masking are native expressions.
Spans, and masking text whose spans may overlap, run over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import SALT, chat_clean, hashed, tokenized

#: The patterns by entity type, and defaults of the tuner.
PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "PHONE_NUMBER": r"(\+91[\-\s]?\d{10})|(\b0\d{2,4}[\-\s]?\d{6,8}\b)|(\b[6-9]\d{9}\b)",
    "AADHAAR": r"\b\d{4}\s\d{4}\s\d{4}\b",
    "PAN": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "CREDIT_CARD": r"\b(?:\d[ \-]*?){13,19}\b",
    "IPV4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ADDRESS": r"(?i)\b(?:H\.?\s*No\.?|Flat|Plot|House|Apt)\.?\s*\d+[\w\s,\-\.]*\d{6}\b",
    "IFSC": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
}
DEFAULT_CONFIDENCE, MIN_THRESHOLD, MAX_THRESHOLD, GRID, MIN_EVENTS = 0.85, 0.50, 0.99, 50, 20
CONSERVATIVE_FACTOR, CONSERVATIVE_FLOOR = 0.8, 0.5
SPAN = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
NER_CHUNK, NER_OVERLAP = 450, 50


#: Every pattern needs a digit or an at sign: texts without them are settled by one cheap test.
SUSPECT = r"[\p{Nd}@]"


def type_counts(text: Column, types: Sequence[str] | None = None) -> dict[str, Column]:
    suspect = text.rlike(SUSPECT)
    return {t: F.when(suspect, F.regexp_count(text, F.lit(PATTERNS[t]))).otherwise(0) for t in types or PATTERNS}


def has_pii(text: Column, types: Sequence[str] | None = None) -> Column:
    found = F.lit(False)
    for t in types or PATTERNS:
        found = found | text.rlike(PATTERNS[t])
    return F.coalesce(text.rlike(SUSPECT) & found, F.lit(False))


def redact_type(text: Column, kind: str) -> Column:
    return F.regexp_replace(text, PATTERNS[kind], f"[REDACTED:{kind}]")


class Detector:
    """Spans of one text; ``ner`` may add (type, start, end, score) of a chunk of it."""

    def __init__(self, thresholds: dict[str, float] | None = None, conservative: bool = False, ner: Callable[[str], Iterable[tuple[str, int, int, float]]] | None = None, types: Sequence[str] | None = None):
        self.thresholds, self.conservative, self.ner = thresholds or {}, conservative, ner
        self.compiled = {t: re.compile(PATTERNS[t]) for t in types or PATTERNS}

    def threshold(self, kind: str) -> float:
        t = self.thresholds.get(kind, DEFAULT_CONFIDENCE)
        return max(CONSERVATIVE_FLOOR, t * CONSERVATIVE_FACTOR) if self.conservative else t

    def spans(self, text: str | None) -> list[tuple[str, str, int, int, float]]:
        if not text:
            return []
        out = {(t, m.start(), m.end()): (t, m[0], m.start(), m.end(), 1.0) for t, p in self.compiled.items() for m in p.finditer(text)}
        if self.ner:
            for at in range(0, len(text), NER_CHUNK - NER_OVERLAP):
                for kind, i, j, score in self.ner(text[at : at + NER_CHUNK]):
                    out.setdefault((kind, at + i, at + j), (kind, text[at + i : at + j], at + i, at + j, float(score)))
        return sorted((s for s in out.values() if s[4] >= self.threshold(s[0])), key=lambda s: (s[2], s[3], s[0]))


def merged_spans(spans: list[tuple[str, str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Overlaps merged into one span that takes the type of its longest part."""
    out: list[list] = []
    for kind, _, start, end, _ in sorted(spans, key=lambda s: (s[2], -s[3], s[0])):
        if out and start < out[-1][2]:
            if end - start > out[-1][3]:
                out[-1][0], out[-1][3] = kind, end - start
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([kind, start, end, end - start])
    return [(k, s, e) for k, s, e, _ in out]


def mask_value(value: str, kind: str, strategy: str, salt: str = SALT) -> str:
    import hashlib
    import hmac

    if strategy == "redact":
        return f"[REDACTED:{kind}]"
    if strategy == "hash":
        return hashlib.sha256((salt + value).encode()).hexdigest()[: max(len(value), 8)]
    if strategy != "tokenize":
        raise ValueError(f"unknown strategy: {strategy}")
    mac, i, out = hmac.new(salt.encode(), value.encode(), "sha256").hexdigest(), 0, []
    for ch in value:
        if not (ch.isdigit() or ch.isalpha()):
            out.append(ch)
            continue
        n = int(mac[i % 64], 16)
        i += 1
        out.append(str(n % 10) if ch.isdigit() else chr((65 if ch.isupper() else 97) + n % 26))
    return "".join(out)


def mask_text(text: str | None, strategy: str = "redact", detector: Detector | None = None, salt: str = SALT) -> str | None:
    if not text:
        return text
    for kind, start, end in reversed(merged_spans((detector or Detector()).spans(text))):
        text = text[:start] + mask_value(text[start:end], kind, strategy, salt) + text[end:]
    return text


def mask_text_with_report(text: str | None, strategy: str = "redact", detector: Detector | None = None, salt: str = SALT) -> tuple[str | None, dict[str, int]]:
    counts: dict[str, int] = {}
    for kind, _, _ in merged_spans((detector or Detector()).spans(text)):
        counts[kind] = counts.get(kind, 0) + 1
    return mask_text(text, strategy, detector, salt), counts


def span_column(text: Column, detector: Detector | None = None, clean_chat: bool = False) -> Column:
    """Array of (type, text, start, end, score); null and empty texts have none."""
    d = detector or Detector()

    @F.arrow_udf(SPAN)
    def spans(column: pa.Array) -> pa.Array:
        rows = [[dict(zip(("type", "text", "start", "end", "score"), s, strict=True)) for s in d.spans(t)] for t in column.to_pylist()]
        kind = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.array(rows, kind)

    source = chat_clean(text) if clean_chat else text
    return spans(source if d.ner else F.when(source.rlike(SUSPECT), source))


def spans_json(text: Column, detector: Detector | None = None) -> Column:
    return F.to_json(span_column(text, detector, clean_chat=True))


def mask_column(text: Column, strategy: str = "redact", detector: Detector | None = None, salt: str = SALT) -> Column:
    """Masked text; texts that no pattern can match reach the Python side as null only."""
    d = detector or Detector()

    @F.arrow_udf(T.StringType())
    def masked(column: pa.Array) -> pa.Array:
        return pa.array([mask_text(t, strategy, d, salt) for t in column.to_pylist()], pa.string())

    return masked(text) if d.ner else F.coalesce(masked(F.when(text.rlike(SUSPECT), text)), text)


def mask_whole(value: Column, strategy: str, kind: str = "VALUE", salt: str = SALT) -> Column:
    """Masks a column whose every value is personal (pincodes, ids)."""
    if strategy == "redact":
        return F.when(value.isNotNull(), F.lit(f"[REDACTED:{kind}]"))
    return hashed(value, salt) if strategy == "hash" else tokenized(value, salt)


def mask_pii_columns(df: DataFrame, columns: Sequence[str], strategy: str = "redact", salt: str = SALT) -> DataFrame:
    """Masks the columns that are there; others are skipped."""
    here = {c: mask_column(F.col(c), strategy, salt=salt) for c in columns if c in df.columns}
    return df.withColumns(here) if here else df


def residual_audit(tables: dict[str, DataFrame], types: Sequence[str] | None = None) -> DataFrame | None:
    """(table, column, entity_type, rows_with_pii, occurrences) over every string column, whole tables."""
    frames = []
    for name, df in tables.items():
        strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if not strings:
            continue
        kinds = list(types or PATTERNS)
        aggs, items = [], []
        for i, c in enumerate(strings):
            for k, n in type_counts(F.col(f"`{c}`"), kinds).items():
                aggs += [F.count_if(n > 0).alias(f"r{i}{k}"), F.coalesce(F.sum(n), F.lit(0)).alias(f"o{i}{k}")]
                items.append(F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(k).alias("entity_type"), F.col(f"r{i}{k}").alias("rows_with_pii"), F.col(f"o{i}{k}").alias("occurrences")))
        frames.append(df.agg(*aggs).select(F.explode(F.array(*items)).alias("x")).select("x.*").filter("rows_with_pii > 0"))
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def audit_verdict(audit: DataFrame) -> dict:
    row = audit.agg(F.count_distinct("table").alias("tables"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("n")).first()
    return {"tables_with_pii": row.tables, "occurrences": row.n, "status": "PASS" if row.n == 0 else "REVIEW_REQUIRED"}


# --- feedback -----------------------------------------------------------------


def entity_metrics(feedback: DataFrame) -> DataFrame:
    """Precision, recall, F1 per entity type from (entity_type, predicted_pii, actual_pii)."""
    p, a = F.col("predicted_pii"), F.col("actual_pii")
    out = feedback.groupBy("entity_type").agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    return _scores(out)


def _scores(counts: DataFrame) -> DataFrame:
    div = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    precision, recall = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": F.round(precision, 4), "recall": F.round(recall, 4), "f1": F.round(div(2 * precision * recall, precision + recall), 4)})


def threshold_grid(feedback: DataFrame, low: float = MIN_THRESHOLD, high: float = MAX_THRESHOLD, steps: int = GRID) -> DataFrame:
    """Counts at every candidate threshold, without expanding events by the grid.

    An event is predicted at all thresholds up to its score: events are counted per
    highest grid step they reach, and suffix sums give each step's counts.
    """
    width = (high - low) / (steps - 1)
    step = F.floor((F.col("score") - low) / width + 1e-9).cast("int")
    step = F.greatest(F.lit(-1), F.least(F.lit(steps - 1), step))
    a = F.col("actual_pii")
    reached = feedback.groupBy("entity_type", step.alias("step")).agg(F.count_if(a).alias("pos"), F.count_if(~a).alias("neg"))
    types = reached.groupBy("entity_type").agg(F.sum("pos").alias("all_pos"), F.sum(F.col("pos") + F.col("neg")).alias("events"))
    grid = types.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    full = grid.join(reached, ["entity_type", "step"], "left")
    suffix = Window.partitionBy("entity_type").orderBy(F.desc("step"))
    full = full.withColumns({"tp": F.sum(F.coalesce("pos", F.lit(0))).over(suffix), "fp": F.sum(F.coalesce("neg", F.lit(0))).over(suffix)})
    full = full.withColumns({"fn": F.col("all_pos") - F.col("tp"), "threshold": F.round(F.lit(low) + F.col("step") * F.lit(width), 6)})
    return _scores(full.select("entity_type", "step", "threshold", "events", "tp", "fp", "fn"))


def tune_thresholds(feedback: DataFrame, min_events: int = MIN_EVENTS) -> DataFrame:
    """(entity_type, events, threshold): the first grid step of the best F1; the default below ``min_events``."""
    grid = threshold_grid(feedback)
    best = grid.groupBy("entity_type", "events").agg(F.max_by("threshold", F.struct("f1", -F.col("step"))).alias("best"))
    return best.select("entity_type", "events", F.when(F.col("events") >= min_events, F.col("best")).otherwise(DEFAULT_CONFIDENCE).alias("threshold"))


def optimal_threshold(tuned: DataFrame, kind: str) -> float:
    row = tuned.filter(F.col("entity_type") == kind).first()
    return row.threshold if row else DEFAULT_CONFIDENCE


def pii_drift(feedback: DataFrame, order_col: str, recent_share: float = 0.25, limit: float = 0.05, min_events: int = MIN_EVENTS) -> DataFrame:
    """Per entity type: miss rate of earlier and recent events, and whether it drifts.

    Events are dealt by quantile of ``order_col``, not by a global sort.  A type only
    seen recently is drift; below ``min_events`` in all, nothing is.
    """
    n = feedback.count()
    cut = feedback.agg(F.percentile_approx(order_col, 1 - recent_share, F.lit(100_000))).first()[0] if n else None
    recent = F.col(order_col) > F.lit(cut)
    actual, missed = F.col("actual_pii"), F.col("actual_pii") & ~F.col("predicted_pii")
    out = feedback.groupBy("entity_type").agg(
        F.count_if(~recent).alias("earlier_events"), F.count_if(recent).alias("recent_events"),
        (F.count_if(~recent & missed) / F.greatest(F.count_if(~recent & actual), F.lit(1))).alias("earlier_fn_rate"),
        (F.count_if(recent & missed) / F.greatest(F.count_if(recent & actual), F.lit(1))).alias("recent_fn_rate"),
    )
    new = (F.col("earlier_events") == 0) & (F.col("recent_events") > 0)
    worse = F.col("recent_fn_rate") - F.col("earlier_fn_rate") > limit
    return out.withColumns({"earlier_fn_rate": F.round("earlier_fn_rate", 4), "recent_fn_rate": F.round("recent_fn_rate", 4), "new_type": new, "drift": (new | worse) & F.lit(n >= min_events)})


def should_use_conservative_mode(feedback: DataFrame, order_col: str) -> bool:
    """Whether any entity type drifts: thresholds are then lowered."""
    return not pii_drift(feedback, order_col).filter("drift").isEmpty()


def tuned_detector(feedback: DataFrame, order_col: str) -> Detector:
    """A detector with tuned thresholds, conservative where drift calls for it."""
    tuned = {r.entity_type: r.threshold for r in tune_thresholds(feedback).collect()}
    return Detector(tuned, conservative=should_use_conservative_mode(feedback, order_col))


def append_feedback(log: DataFrame | None, events: DataFrame, order_col: str = "timestamp", keep: int = 10_000) -> DataFrame:
    """The log with new events, the latest ``keep`` of them."""
    out = events if log is None else log.unionByName(events)
    return out.orderBy(F.desc(order_col)).limit(keep)


def bio_samples(n: int, seed: int = 42) -> list[dict]:
    """Token and tag lists for training a name tagger, from a few sentence patterns."""
    rng = np.random.default_rng(seed)
    names, verbs = ["Asha Rao", "Ravi Kumar", "Meena Iyer", "Arjun Singh"], ["called", "ordered from", "wrote to", "met"]
    labels = {"O": 0, "B-PER": 1, "I-PER": 2, "B-EMAIL": 3, "B-PHONE": 4}
    out = []
    for _ in range(n):
        name, phone = str(rng.choice(names)), "".join(rng.choice(list("6789")) + "".join(map(str, rng.integers(0, 10, 9))) for _ in range(1))
        tokens = [*name.split(), *str(rng.choice(verbs)).split(), "support", "at", phone]
        tags = [labels["B-PER"], labels["I-PER"]] + [0] * (len(tokens) - 3) + [labels["B-PHONE"]]
        out.append({"tokens": tokens, "ner_tags": tags})
    return out
