"""Accounting codes, supplier and invoice keys, and the policy that holds a customer's own values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.strings import col, collapse, extract, strip

# Tokens that stand for "no value" in budget sheets.
PLACEHOLDERS = ("", "multiple", "unknown", "none", "non-dt", "open", "n/a", "na", "tbd", "various")

# Legal-form endings ignored when comparing supplier core names.
LEGAL_ENDINGS = "incorporated|corporation|limited|company|llc|ltd|inc|corp|llp|plc|pvt|gmbh"

# Task names that mean paid time off, and timesheet statuses that count as billable.
TIME_OFF = r"(?i)time\s*off|\bpto\b"
COUNTED_STATUSES = ("posted", "submitted")

CAPEX, OPEX = "CAPEX", "OPEX"


@dataclass(frozen=True)
class Company:
    """One company of the customer: its codes, the lines of business it owns, and a project-name pattern."""

    name: str
    code: str
    cost_center: str
    lines_of_business: tuple[str, ...] = ()
    project_pattern: str | None = None


@dataclass(frozen=True)
class Policy:
    """Customer-specific accounting values. Companies are tried in order for project-name patterns."""

    companies: tuple[Company, ...] = ()
    # Ledger codes per expense class, and texts in vendor names that lead to another code than ``opex_gl``.
    capex_gl: str = ""
    opex_gl: str = ""
    opex_gl_by_vendor_text: dict[str, str] = field(default_factory=dict)
    supplier_number_prefix: str = ""

    def _choose(self, key: Column, attribute: str) -> Column:
        result = F.lit(None).cast("string")
        for company in self.companies:
            result = F.when(key == company.name, getattr(company, attribute)).otherwise(result)
        return result

    def company_code(self, company: Column) -> Column:
        return self._choose(company, "code")

    def company_cost_center(self, company: Column) -> Column:
        return self._choose(company, "cost_center")

    def company_for_line_of_business(self, line_of_business: Column) -> Column:
        lob = F.lower(strip(line_of_business))
        result = F.lit(None).cast("string")
        for company in self.companies:
            if company.lines_of_business:
                result = F.when(lob.isin(*company.lines_of_business), company.name).otherwise(result)
        return result

    def company_for_project_name(self, project_name: Column) -> Column:
        result = F.lit(None).cast("string")
        for company in reversed(self.companies):
            if company.project_pattern:
                result = F.when(project_name.rlike("(?i)" + company.project_pattern), company.name).otherwise(result)
        return result

    def gl_code(self, expense_class: Column, vendor: Column) -> Column:
        """Ledger code of a line: one code for CAPEX, a vendor-dependent one for OPEX, else blank."""
        opex = F.lit(self.opex_gl)
        for text, code in reversed(list(self.opex_gl_by_vendor_text.items())):
            opex = F.when(F.lower(vendor).contains(text), code).otherwise(opex)
        kind = expense_class_of(expense_class)
        return F.when(kind == CAPEX, self.capex_gl).when(kind == OPEX, opex).otherwise("")

    def class_of_gl(self, gl_code: Column) -> Column:
        """Reverse map of the two ledger codes; joined lists, overrides and blanks are unknown."""
        code = F.nullif(strip(gl_code), F.lit(""))
        return F.when(code == self.capex_gl, CAPEX).when(code == self.opex_gl, OPEX)

    def cost_center(self, company: Column, expense_class: Column, department_code: Column) -> Column:
        """OPEX is coded to the person's department, everything else to the company's center."""
        return F.when(
            expense_class_of(expense_class) == OPEX, F.coalesce(department_code, F.lit(""))
        ).otherwise(F.coalesce(self.company_cost_center(company), F.lit("")))


def is_time_off(task: Column | str) -> Column:
    return F.coalesce(col(task).rlike(TIME_OFF), F.lit(False))


def is_posted(status: Column | str) -> Column:
    return F.coalesce(F.lower(strip(status)) == "posted", F.lit(False))


def counts_as_billable(posted: Column | str, status: Column | str) -> Column:
    """Posted or submitted. A missing status does not count."""
    by_status = F.lower(strip(status)).isin(*COUNTED_STATUSES)
    return F.coalesce(col(posted), F.lit(False)) | F.coalesce(by_status, F.lit(False))


def charge_class(charge_code: Column | str) -> Column:
    text = F.lower(col(charge_code))
    return F.when(text.contains("capital"), CAPEX).when(text.contains("operating"), OPEX)


def expense_class_of(value: Column | str) -> Column:
    kind = F.upper(strip(value))
    return F.when(kind.isin(CAPEX, OPEX), kind)


def normalize_supplier(name: Column | str) -> Column:
    """Supplier key: drop a trailing ``(…)``, then ``-digits``; punctuation to blanks; drop ``com``."""
    s = F.regexp_replace(F.coalesce(col(name), F.lit("")), r"\s*\([^)]*\)\s*$", "")
    s = F.regexp_replace(s, r"-\d+\s*$", "")
    s = F.regexp_replace(F.lower(s), r"[^a-z0-9]+", " ")
    return collapse(F.regexp_replace(s, r"\bcom\b", " "))


def supplier_core_key(normalized: Column | str) -> Column:
    """Despaced supplier key without its trailing run of legal endings."""
    return F.regexp_replace(F.replace(col(normalized), F.lit(" "), F.lit("")), rf"({LEGAL_ENDINGS})+$", "")


def invoice_number_key(value: Column | str) -> Column:
    """Lower case, no whitespace, ``6347.0`` -> ``6347``; a missing number is blank."""
    text = F.regexp_replace(F.lower(col(value).cast("string")), r"\s+", "")
    return F.coalesce(F.regexp_replace(text, r"^(\d+)\.0$", "$1"), F.lit(""))


def code_prefix(value: Column | str) -> Column:
    """Leading account code of a labelled cell: ``DT600 - Apps`` -> ``DT600``."""
    return extract(strip(value), r"^\s*([A-Za-z]{1,4}\d{3,6}|\d{3,6})\b")


def clean_cell(value: Column | str) -> Column:
    """Cell text, or null for blanks and placeholder tokens."""
    text = strip(value)
    return F.when(~F.lower(text).isin(*PLACEHOLDERS), text)


def invoice_number_from_name(stem: Column | str) -> Column:
    """Invoice number from a document name: an embedded code, else the first token with a digit, else all."""
    stem = col(stem)
    with_digit = F.filter(F.split(stem, r"[_\s]+"), lambda t: t.rlike(r"\d"))
    return F.coalesce(extract(stem, r"([A-Za-z]{2,6}\d{5,}[A-Za-z0-9-]*)"), F.get(with_digit, F.lit(0)), stem)


def other_invoice_number_from_name(stem: Column | str) -> Column:
    return extract(stem, r"(?U)([A-Za-z]{0,4}\d[\w-]{3,})")


def safe_name_part(value: Column | str) -> Column:
    """Text safe inside a file name: illegal characters dropped, blanks collapsed, outer dots trimmed."""
    kept = collapse(F.regexp_replace(col(value), r'[\\/:*?"<>|]', ""))
    return F.regexp_replace(kept, r"^\.+|\.+$", "")


def missing_fields(checks: list[tuple[str, Column]]) -> Column:
    """Ordered list of the names whose check (field present) is false."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(present, F.lit(False)), F.lit(label)) for label, present in checks])
    )


def is_set(value: Column | str) -> Column:
    """A text field is present when it is neither null nor blank."""
    return F.coalesce(col(value) != "", F.lit(False))


