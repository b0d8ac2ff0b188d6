"""All query modules; importing this fills the registry."""

from tallyweave.plans import timesheet_queries  # noqa: F401  isort: skip
from tallyweave.plans import matching_queries  # noqa: F401  isort: skip
from tallyweave.plans import report_queries  # noqa: F401  isort: skip
from tallyweave.plans import supplier_queries  # noqa: F401  isort: skip
from tallyweave.plans import export_queries  # noqa: F401  isort: skip
from tallyweave.plans import text_queries  # noqa: F401  isort: skip
from tallyweave.plans import stream_queries  # noqa: F401  isort: skip
from tallyweave.plans.registry import MODULES, ORACLES, QUERIES

__all__ = ["MODULES", "ORACLES", "QUERIES"]
