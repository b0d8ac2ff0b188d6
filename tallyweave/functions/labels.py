"""Display labels of the boards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.strings import col

# Invoice statuses, types and their display labels.
MATCHED, FLAGGED = "matched", "flagged"
NEEDS_REVIEW, FAILED = "needs_manual_review", "processing_failed"
ALL_DATA_FOUND, MISSING_DATA = "all_data_found", "missing_data"
CONTRACTOR, OTHER = "contractor", "other"
STATUS_LABELS = {MATCHED: "VERIFIED", FLAGGED: "CONFLICT", NEEDS_REVIEW: "MISSING INFO", FAILED: "FAILED"}
MODEL_BADGE, TEMPLATE_BADGE = "AI-PARSED", "AUTO-LEARNED"


def status_label(status: Column | str) -> Column:
    result = F.lit(None).cast("string")
    for key, label in STATUS_LABELS.items():
        result = F.when(col(status) == key, label).otherwise(result)
    return result


def method_badge(method: Column | str) -> Column:
    """Only parses that involved a model or a learned template carry a badge."""
    method = col(method)
    return F.when(method.contains("llm"), MODEL_BADGE).when(method == "template", TEMPLATE_BADGE)


def route_label(status: Column | str) -> Column:
    return F.when(col(status) == MATCHED, MATCHED).otherwise(FLAGGED)
