"""Reading labelled values from text: a field is a table of readings, tried in order.

A reading is a label, what may stand between label and value, and the kind of value. A kind is a token that finds candidates
and a shape that decides; the first candidate of the right shape is the value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.dates import MONTHS
from tallyweave.functions.strings import strip

# --- value tokens -------------------------------------------------------------------------------------
DASH = "[-–]"
UNTIL = f"to|through|{DASH}"
MONTH = f"(?:{MONTHS})"
SLASH_DATE = r"\d{1,2}/\d{1,2}/\d{2,4}"
HYPHEN_DATE = r"\d{1,2}-[A-Za-z]{3}-\d{2,4}"
DAY_MONTH = rf"\d{{1,2}}[\s/-]*{MONTH}\.?"
DAY_MONTH_YEAR = rf"{DAY_MONTH}[\s,]*\d{{4}}"
MONTH_DAY = rf"{MONTH}\.?\s+\d{{1,2}}"
MONTH_DAY_YEAR = rf"{MONTH_DAY},?\s*\d{{4}}"
MONTH_YEAR = rf"{MONTH}\.?\s+\d{{4}}"
#: Digits in groups, with a decimal part after a point or a comma.
AMOUNT = r"\d+(?:[ ,.]\d{3})*(?:[.,]\d+)?"
LETTERS_AND_DIGITS = r"[A-Za-z0-9][A-Za-z0-9/-]*"
REST_OF_LINE = r"[^\r\n]+"


@dataclass(frozen=True)
class Kind:
    token: str
    shape: str = ""


@dataclass(frozen=True)
class Reading:
    """``label``: words, blanks between them optional; none: anywhere in the text."""

    label: str
    kind: Kind
    between: str = r"[\s:]*"

    def pattern(self) -> str:
        label = label_pattern(self.label) + self.between if self.label else r"(?<![A-Za-z0-9])"
        return f"(?i){label}({self.kind.token})"


def label_pattern(words: str) -> str:
    r"""The words of a label, with any blanks or none between them."""
    return r"\b" + r"\s*".join(rf"\Q{word}\E" for word in words.split())


def any_word(words: tuple[str, ...]) -> str:
    """Any of the words, standing alone."""
    return r"(?i)(?<!\w)(?:" + "|".join(rf"\Q{word}\E" for word in words) + r")(?!\w)"


def candidates(text: Column, reading: Reading) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(reading.pattern()), 1), lambda v: strip(v))
    return F.filter(found, lambda v: v.rlike(reading.kind.shape)) if reading.kind.shape else found


def read(text: Column, readings: tuple[Reading, ...]) -> Column:
    """The value of the first reading that finds one, else null."""
    return F.coalesce(*[F.get(candidates(text, reading), F.lit(0)) for reading in readings])


def span(first: str, between: str, second: str) -> str:
    """Two tokens with something between them, as two groups."""
    return rf"(?i)(?<!\d)({first})\s*(?:{between})\s*({second})"


# --- what the fields are called -------------------------------------------------------------------------
CODE = Kind(LETTERS_AND_DIGITS, r"^(?=.*\d).{5,}$")
MARKED_CODE = Kind(r"INV[\s-]?\d+", r"\d{3,}$")
LONG_CODE = Kind(r"[A-Za-z]+\d+(?![A-Za-z0-9])", r"^[A-Za-z]{2,5}\d{8,}$")
COUNTER = Kind(r"\d+(?![A-Za-z0-9])", r"^\d{3,}$")
INVOICE_NUMBER = (
    Reading("invoice number", CODE, r"[\s.:]*"),
    Reading("invoice no", CODE, r"[\s.:]*"),
    Reading("invoice #", CODE, r"[\s.:]*"),
    Reading("", MARKED_CODE),
    Reading("", LONG_CODE),
    Reading("invoice", COUNTER, r"\s*#?\s*"),
)

DATED = Kind(rf"{SLASH_DATE}|{HYPHEN_DATE}|\d{{1,2}}-\d{{1,2}}-\d{{2,4}}|\d{{1,2}}/{MONTH}/\d{{2,4}}")
SLASHED = Kind(SLASH_DATE + r"(?!\d)", r"/\d{4}$")
HYPHENED = Kind(HYPHEN_DATE + r"(?!\d)", r"-\d{4}$")
DOTTED_DATE = r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b"
SPELLED = Kind(rf"{MONTH}\.?\s+\d{{1,2}},?\s+\d{{4}}(?!\d)")
INVOICE_DATE = (
    Reading("invoice date", DATED),
    Reading("date", SLASHED),
    Reading("", SLASHED),
    Reading("", HYPHENED),
    Reading("", SPELLED),
)

MONEY = Kind(AMOUNT)
CENTS = Kind(AMOUNT, r"\.\d{2}$")
CURRENCY = r"(?:[\s:()$]|USD|US)*"
INVOICE_TOTAL = (
    Reading("total invoice value", MONEY, CURRENCY),
    Reading("total to be paid", MONEY, CURRENCY),
    Reading("gross value", MONEY, CURRENCY),
    Reading("total amount due", MONEY, CURRENCY),
    Reading("total amount", MONEY, CURRENCY),
    Reading("total due", MONEY, CURRENCY),
    Reading("amount due", MONEY, CURRENCY),
    Reading("balance due", MONEY, CURRENCY),
    Reading("total (usd)", MONEY, r"\s*"),
    Reading("total", CENTS, r"[\s$]*"),
    Reading("total", MONEY, r"\s*\$\s*"),
)

PLAIN_NAME = Kind(REST_OF_LINE, r"^[A-Za-z0-9 .,&]+$")
BENEFICIARY = (Reading("beneficiary name", PLAIN_NAME), Reading("name of account", PLAIN_NAME))
# Words that mark a line as a company's name.
COMPANY_WORDS = (
    "LLC", "L.L.C.", "Inc", "Inc.", "Ltd", "Ltd.", "Limited", "LLP", "Corp", "Corp.", "Corporation", "Technologies", "Solutions",
    "Consulting",
)

# --- billing periods ------------------------------------------------------------------------------------
PERIOD_WORD = r"(?i)period"
#: Two dates as printed, in the order in which they are tried.
PRINTED_SPANS = (
    span(SLASH_DATE, DASH, SLASH_DATE),
    span(HYPHEN_DATE, f"to|{DASH}", HYPHEN_DATE),
    span(rf"\d{{1,2}}{MONTH}\d{{4}}", "to", rf"\d{{1,2}}{MONTH}\d{{4}}"),
    span(MONTH_DAY, DASH, MONTH_DAY_YEAR),
)
DAYS_OF_A_MONTH = rf"(?i)\b({MONTH_DAY})\s*{DASH}\s*(\d{{1,2}}),?\s*(\d{{4}})"
BILLED = label_pattern("billed from date")
BILLED_SPAN = span(HYPHEN_DATE, r"(?<=\s)", HYPHEN_DATE)
SPELLED_SPAN = span(DAY_MONTH_YEAR, UNTIL, DAY_MONTH_YEAR)
SPAN_OF_ONE_YEAR = span(DAY_MONTH, UNTIL, DAY_MONTH_YEAR)
TIME_CARD = "(?i)" + label_pattern("time card by company invoice")
TIME_CARD_DAY = rf"(?m)^({SLASH_DATE})\s+(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s"
MONTH_OF = "(?i)" + label_pattern("for the month of") + rf"\s*({MONTH})\.?,?\s*(\d{{4}})"
MONTH_OF_SERVICE = rf"(?i)\b({MONTH})\s+(\d{{4}})\s+service"
BARE_MONTH = rf"(?i)\b({MONTH})\.?\s+(\d{{4}})\b"
PRINTED_YEAR = r"\b\d{4}\b"
GAP = rf"(?:\s|{DASH})*"


def any_token(*tokens: str) -> str:
    return "(?:" + "|".join(tokens) + ")"


#: Months and dates that close a line, however many.
DATES_AT_THE_END = rf"(?i)(?:{GAP}{any_token(MONTH_YEAR, HYPHEN_DATE, SLASH_DATE)})+{GAP}$"
#: Where a description is cut when a person's name is sought beside its dates.
DATE_IN_TEXT = "(?i)" + any_token(DAY_MONTH_YEAR, MONTH_DAY_YEAR, HYPHEN_DATE, SLASH_DATE, MONTH_YEAR, DAY_MONTH, PRINTED_YEAR)
