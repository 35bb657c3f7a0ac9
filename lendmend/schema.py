"""Domain schemas, the data dictionary and the rule bounds.

Schemas are fixed by dictionary and never inferred from data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "map<string double>": T.MapType(T.StringType(), T.DoubleType()),
}


def _struct(fields: str) -> T.StructType:
    """'name type, name type'; unlike ``fromDDL`` it needs no running session."""
    pairs = [f.strip().split(" ", 1) for f in fields.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CUSTOMER_BASE = _struct(
    "customer_id string, birth_year int, age int, work_type string, has_mobile boolean, "
    "has_id_card boolean, has_driving_licence boolean, has_passport boolean"
)

LOAN_HISTORY = _struct(
    "customer_id string, loan_id string, disbursed_amount double, disbursed_date timestamp, "
    "asset_cost double, ltv double, branch_id string, dealer_id string, manufacturer_id string, "
    "area_id string, term int, rate double, product string, apply_time timestamp, status string, "
    "overdue_cnt int, ingest_ts timestamp"
)

ACCOUNT_MEASURES = {
    "loan_cnt": "int",
    "active_cnt": "int",
    "overdue_cnt": "int",
    "outstanding": "double",
    "approved": "double",
    "disbursed": "double",
    "installment": "double",
    "n_periods": "int",
}

ACCOUNT_BEHAVIOR = _struct(
    "customer_id string, "
    + ", ".join(
        f"{prefix}_{name} {kind}"
        for prefix in ("pri", "sec", "total")
        for name, kind in ACCOUNT_MEASURES.items()
    )
)

REPAYMENT = _struct(
    "customer_id string, overdue_total int, outstanding_disbursed_ratio double, "
    "disbursed_approved_ratio double, active_inactive_ratio double, loan_default int"
)

CREDIT_BUREAU = _struct(
    "customer_id string, credit_score int, credit_grade string, credit_history string, "
    "inquiry_cnt int, new_loans_6m int, defaults_6m int, avg_loan_term double"
)

APPLICATION = _struct(
    "application_id string, customer_id string, apply_time timestamp, amount double, term int, "
    "purpose string, area_id string, features map<string double>"
)

AREA_LOOKUP = _struct(
    "area_id string, area_name string, latitude double, longitude double"
)

BUSINESS_EVENT = _struct("event_ts timestamp, event_type string, note string")

LIFE_EVENT = _struct("customer_id string, event_ts timestamp, event_type string")

REPAIRED_CELL = _struct(
    "customer_id string, feature string, value string, method string, confidence double, "
    "evidence string"
)


def dictionary_of(schema: T.StructType) -> dict[str, str]:
    """Column -> SQL type name, the form that ``clean.typed`` takes."""
    return {f.name: f.dataType.simpleString() for f in schema.fields}


@dataclass(frozen=True)
class Rules:
    """Business bounds. Everything the business may tune sits here."""

    age_low: int = 18
    age_high: int = 100
    rate_low: float = 0.0  # exclusive
    rate_high: float = 36.0  # inclusive, percent
    overdue_policy: str = "null"  # null | abs | zero
    low_quality_share: float = 0.5
    low_quality_weight: float = 0.5
    min_support: float = 0.1
    min_confidence: float = 0.6
    heat_red: float = 0.10
    heat_yellow: float = 0.05
    score_base: float = 2.0


@dataclass(frozen=True)
class FraudRules:
    """Thresholds of the fraud features."""

    burst_count: int = 3
    burst_days: int = 7
    max_inquiries: int = 10
    min_credit_start_age: int = 16
    max_distance_km: float = 500.0
    max_absent_documents: int = 2
    documents: tuple[str, ...] = field(
        default=("has_mobile", "has_id_card", "has_driving_licence", "has_passport")
    )


# Grade and age bands (lower bound inclusive), best grade first.
GRADE_FLOORS = (("excellent", 750), ("good", 650), ("fair", 550))
GRADE_LOWEST = "poor"
AGE_FLOORS = (("old", 50), ("middle", 30), ("young", 18))

# What each grade is offered.
GRADE_POLICY = {
    "excellent": "best rate, highest limit",
    "good": "standard rate, standard limit",
    "fair": "raised rate, reduced limit",
    "poor": "guarantee required or reject",
}

# What each area colour means for the local strategy.
AREA_POLICY = {
    "red": "stricter approval, lower limit",
    "yellow": "monitor",
    "green": "expand",
}

# Action per customer segment, best segment first.
SEGMENT_POLICY = {
    1: "offer large loans",
    2: "grow",
    3: "build credit",
    4: "closer post-loan monitoring",
    5: "cautious credit or reject",
}

# Timeline colour by event.
EVENT_COLOURS = {
    "application": "grey",
    "disbursement": "grey",
    "repaid_on_time": "green",
    "overdue": "yellow",
    "severe_default": "red",
    "settled": "blue",
}
