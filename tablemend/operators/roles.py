"""Semantic column roles and the strategy derived from them (PRO1-PRO10)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import col, lenient_timestamp
from ..functions.moments import sketch_distinct
from ..functions.schema import is_numeric, is_temporal, is_text, numeric_columns, target_of, text_columns
from .correlate import target_correlations
from .profile import distinct_counts, rows_frame

# Starts of text that reads like a date.
DATE_STARTS = [
    r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    r"\d{1,2}[-/]\d{1,2}[-/]\d{4}",
    r"\d{1,2}[-/]\w+[-/]\d{4}",
    r"\w+\s+\d{1,2},?\s+\d{4}",
]

# Parts of a name that mark an identifier column.
IDENTIFIER_WORDS = ["id", "code", "number", "no", "name", "icao", "identifier", "key"]

# Words of ordered scales.
ORDINAL_SCALES = [
    ["low", "medium", "high"],
    ["small", "medium", "large"],
    ["poor", "fair", "good", "excellent"],
    ["junior", "senior", "lead", "manager"],
    ["level 1", "level 2", "level 3"],
]

# Words in a column name that hint at an order in time.
TIME_WORDS = ["date", "timestamp", "time", "year", "month", "quarter"]

# Domain keywords, label and industry.
DOMAINS = {
    "aviation": (
        [
            "flight", "airport", "icao", "iata", "dep", "arr", "airline", "runway", "altitude", "aircraft",
            "terminal", "passenger", "cargo", "aviation", "atc"
        ],
        "Aviation / Air Transport",
        "Aviation & Aerospace",
    ),
    "finance": (
        [
            "amount", "price", "loan", "credit", "balance", "fiscal", "interest", "deal", "revenue",
            "profit", "transaction", "payment", "invoice"
        ],
        "Finance / International Trade",
        "Banking & Financial Services",
    ),
    "healthcare": (
        [
            "age", "blood", "patient", "diagnosis", "treatment", "cancer", "medical", "hospital",
            "symptom", "drug"
        ],
        "Healthcare / Clinical",
        "Medical Research",
    ),
    "marketing": (
        [
            "customer", "click", "conversion", "sale", "lead", "campaign", "churn", "retention",
            "engagement"
        ],
        "E-commerce / Marketing",
        "Retail & Digital Marketing",
    ),
    "manufacturing": (
        [
            "machine", "downtime", "defect", "production", "assembly", "quality", "sensor", "temperature",
            "pressure", "vibration"
        ],
        "Manufacturing / IoT",
        "Industrial Manufacturing",
    ),
}
GENERAL = ("general", "General Purpose", "Cross-industry")

HIGH_CARDINALITY = 50
SMALL_ROWS = 500

IDENTIFIER, DATETIME, NUMERICAL = "identifier", "datetime", "numerical"
NOMINAL, ORDINAL, TARGET, OTHER = "nominal", "ordinal", "target", "other"


def name_marks_identifier(name: str, whole_words: bool = False) -> bool:
    """Does the name contain an identifier word? ``whole_words`` asks for a word of its own."""
    lowered = name.lower()
    if whole_words:
        return bool(set(name_words(name)) & set(IDENTIFIER_WORDS))
    return any(word in lowered for word in IDENTIFIER_WORDS)


def name_words(name: str) -> list[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return [w.lower() for w in re.split(r"[^A-Za-z0-9]+", spaced) if w]


def detect_roles(df: DataFrame, target: str | None = None, whole_words: bool = False) -> dict[str, str]:
    """Role of every column, first rule that holds: datetime, identifier, numerical, ordinal, nominal.

    All text columns are judged over all their values in one aggregate. Only columns whose
    every value could be a date are parsed, and only ratios the sketch leaves open are recounted.
    """
    target = target_of(df, target)
    others = [f for f in df.schema if f.name != target]
    texts = [f.name for f in others if is_text(f.dataType)]
    row = {}
    if texts:
        starts = "^(?:" + "|".join(f"(?:{p})" for p in DATE_STARTS) + ")"
        possible = r"^\s*(?:\d|[A-Za-z]{3,9}[ .,]).{0,38}$"
        scale_words = sorted({w for scale in ORDINAL_SCALES for w in scale})
        parts = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(texts):
            parts += [
                F.count(col(c)).alias(f"present{i}"),
                F.count_if(col(c).rlike(starts)).alias(f"dates{i}"),
                F.bool_and(col(c).rlike(possible)).alias(f"possible{i}"),
                F.bool_or(F.lower(col(c)).isin(scale_words)).alias(f"ordinal{i}"),
                sketch_distinct(col(c)).alias(f"distinct{i}"),
            ]
        row = df.agg(*parts).first().asDict()

    at = {c: i for i, c in enumerate(texts)}
    dates = {c for c, i in at.items() if row[f"present{i}"] and row[f"dates{i}"] > 0.7 * row[f"present{i}"]}
    unsure = [c for c, i in at.items() if c not in dates and row[f"present{i}"] and row[f"possible{i}"]]
    if unsure:
        parsed = df.agg(
            *[F.bool_and(lenient_timestamp(col(c)).isNotNull() | col(c).isNull()).alias(f"p{i}") for i, c in enumerate(unsure)]
        ).first()
        dates |= {c for i, c in enumerate(unsure) if parsed[f"p{i}"]}

    unique = {}
    for c, i in at.items():
        unique[c] = row[f"distinct{i}"] / row["rows"] if row["rows"] else 0.0
    close = [
        c
        for c in texts
        if c not in dates and not name_marks_identifier(c, whole_words) and row["rows"] > 50 and abs(unique[c] - 0.8) < 0.06
    ]
    if close:
        exact = df.agg(*[F.count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(close)]).first()
        unique.update({c: exact[f"d{i}"] / row["rows"] for i, c in enumerate(close)})

    roles = {}
    for f in df.schema:
        c = f.name
        if c == target:
            roles[c] = TARGET
        elif is_temporal(f.dataType) or c in dates:
            roles[c] = DATETIME
        elif is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType):
            roles[c] = NUMERICAL
        elif c in at and (name_marks_identifier(c, whole_words) or (unique[c] > 0.8 and row["rows"] > 50)):
            roles[c] = IDENTIFIER
        elif c in at:
            roles[c] = ORDINAL if row[f"ordinal{at[c]}"] else NOMINAL
        else:
            roles[c] = OTHER
    return roles


def column_roles(df: DataFrame, target: str | None = None) -> DataFrame:
    """The roles as a table (column, role); also how they join the diagnostics (DGN19)."""
    return rows_frame(df.sparkSession, list(detect_roles(df, target).items()), "column string, role string")


def infer_domain(columns: list[str]) -> tuple[str, str, str]:
    """Domain whose keywords occur most often in the joined column names; ties go to the first."""
    blob = " ".join(c.lower() for c in columns)
    scores = {key: sum(word in blob for word in words) for key, (words, _, _) in DOMAINS.items()}
    best = max(scores, key=scores.get)
    return (best, *DOMAINS[best][1:]) if scores[best] else GENERAL


def high_cardinality(df: DataFrame, target: str | None = None, threshold: int = HIGH_CARDINALITY) -> list[str]:
    """Text columns with more distinct values than the threshold (PRO8)."""
    counts = distinct_counts(df, text_columns(df, [target_of(df, target)]), watch=2 * threshold)
    return [c for c, n in counts.items() if n > threshold]


def task_type(df: DataFrame, target: str | None = None) -> str:
    """Regression for a numeric target with more than 20 distinct values, else classification (PRO10)."""
    target = target_of(df, target)
    if not is_numeric(df.schema[target].dataType):
        return "classification"
    return "regression" if distinct_counts(df, [target], watch=100)[target] > 20 else "classification"


@dataclass(frozen=True)
class Strategy:
    """What the repair steps need to know about a table (PRO9)."""

    target: str
    rows: int
    dataset_type: str
    domain: str
    domain_label: str
    industry: str
    roles: dict[str, str]
    protected: tuple[str, ...]
    high_cardinality: tuple[str, ...]
    recommendations: tuple[str, ...] = field(default=())

    @property
    def is_small(self) -> bool:
        return self.rows < SMALL_ROWS

    def with_role(self, role: str) -> list[str]:
        return [c for c, r in self.roles.items() if r == role]


def dataset_type(df: DataFrame, roles: dict[str, str], rows: int) -> str:
    """time_series, relational, tabular_small or tabular_large (PRO5).

    A time word must be a word of the name, so that ``update_count`` is no date.
    """
    if DATETIME in roles.values():
        return "time_series"
    for f in df.schema:
        if is_numeric(f.dataType) and set(name_words(f.name)) & set(TIME_WORDS):
            return "time_series"
    if IDENTIFIER in roles.values():
        return "relational"
    return "tabular_small" if rows < SMALL_ROWS else "tabular_large"


def protected_columns(df: DataFrame, target: str, roles: dict[str, str], domain: str) -> list[str]:
    """Target, identifiers, the five columns most correlated with the target, domain columns (PRO7)."""
    kept = {target} | {c for c, r in roles.items() if r == IDENTIFIER}
    if target in numeric_columns(df) and len(numeric_columns(df)) > 1:
        kept |= {r["column"] for r in target_correlations(df, target).collect()}
    words = DOMAINS[domain][0] if domain in DOMAINS else []
    kept |= {c for c in df.columns if any(w in c.lower() for w in words)}
    return sorted(kept)


def build_strategy(df: DataFrame, target: str | None = None) -> Strategy:
    target = target_of(df, target)
    roles = detect_roles(df, target)
    rows = df.count()
    kind = dataset_type(df, roles, rows)
    domain, label, industry = infer_domain(df.columns)
    wide = high_cardinality(df, target)
    advice = []
    if kind == "time_series":
        advice += ["Add lag features and rolling statistics", "Keep the order in time; do not shuffle"]
    if kind == "relational":
        advice += ["Count rows per identifier as a feature", "Keep identifiers for features by group"]
    if rows < SMALL_ROWS:
        advice += ["Limit feature engineering against overfitting", "Avoid strong transformations"]
    if wide:
        advice.append(f"Use frequency encoding for high-cardinality columns: {', '.join(wide)}")
    if domain == "aviation":
        advice.append("Add traffic volume and departure to arrival ratio")
    return Strategy(
        target=target,
        rows=rows,
        dataset_type=kind,
        domain=domain,
        domain_label=label,
        industry=industry,
        roles=roles,
        protected=tuple(protected_columns(df, target, roles, domain)),
        high_cardinality=tuple(wide),
        recommendations=tuple(advice),
    )


def strategy_table(df: DataFrame, target: str | None = None) -> DataFrame:
    """The strategy as rows (item, value)."""
    s = build_strategy(df, target)
    rows = [
        ("dataset_type", s.dataset_type),
        ("domain", s.domain),
        ("domain_label", s.domain_label),
        ("industry", s.industry),
        ("is_small", str(s.is_small).lower()),
        ("time_series_target", s.target if s.dataset_type == "time_series" else ""),
    ]
    rows += [("protected", c) for c in s.protected]
    rows += [("high_cardinality", c) for c in s.high_cardinality]
    rows += [("identifier", c) for c in s.with_role(IDENTIFIER)]
    rows += [("recommendation", r) for r in s.recommendations]
    return rows_frame(df.sparkSession, rows, "item string, value string")
