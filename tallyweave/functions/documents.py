"""Column expressions over document text: header fields, periods, person names, small cleaners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions import patterns as P
from tallyweave.functions import readings as R
from tallyweave.functions.dates import full_month, parse_date, period_text
from tallyweave.functions.money import clean_number
from tallyweave.functions.strings import blank_to_null, collapse, extract, let, strip, text_lines


def first_of(values: Column) -> Column:
    """First non-null element of an array."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def hits(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of one group, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), group)


# --- vendor and header --------------------------------------------------------------------------------
def clean_vendor(name: Column) -> Column:
    """Drop date or month descriptors at the end of a vendor line, however many."""
    return blank_to_null(strip(F.regexp_replace(F.regexp_replace(strip(name), R.DATES_AT_THE_END, ""), r"[-–\s]+$", "")))


def clean_service_vendor(name: Column) -> Column:
    """Fold a stylised ``@`` to ``a`` and keep the legal name before ``dba``."""
    return blank_to_null(strip(F.regexp_replace(F.replace(name, F.lit("@"), F.lit("a")), r"(?is)\s+dba\s+.*$", "")))


def clean_description(text: Column) -> Column:
    """Without a row index, a leading date and control characters; blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, P.ROW_INDEX, ""), P.ROW_DATE, "")
    return collapse(F.regexp_replace(bare, r"[\x00-\x1f]", " "))


def header_vendor(text: Column, customer_pattern: str | None = None) -> Column:
    """Labelled beneficiary, else the first company line that is not the customer's, else the first real line."""
    def is_vendor(line):
        named = line.rlike(R.any_word(R.COMPANY_WORDS))
        return named & ~line.rlike("(?i)" + customer_pattern) if customer_pattern else named

    lines = F.transform(text_lines(text), lambda line: strip(line))
    company = F.get(F.filter(lines, is_vendor), F.lit(0))
    real = F.get(F.filter(lines, lambda s: (s != "") & ~F.lower(s).isin(*P.GENERIC_LINES)), F.lit(0))
    return clean_vendor(F.coalesce(R.read(text, R.BENEFICIARY), company, real))


def header_number(text: Column) -> Column:
    return R.read(text, R.INVOICE_NUMBER)


def header_date(text: Column) -> Column:
    return parse_date(R.read(text, R.INVOICE_DATE))


def dotted_date(text: Column) -> Column:
    """A date printed as month.day.year, which no other form of a date is."""
    return let(
        extract(text, R.DOTTED_DATE, 0),
        lambda found: parse_date(F.concat_ws("/", *[extract(found, R.DOTTED_DATE, i) for i in (1, 2, 3)])),
    )


def header_total(text: Column) -> Column:
    return clean_number(R.read(text, R.INVOICE_TOTAL))


# --- periods --------------------------------------------------------------------------------------------
def _range(text: Column, pattern: str) -> Column:
    """``first - second`` of a two-date pattern."""
    return let(
        extract(text, pattern, 0),
        lambda m: F.concat(extract(m, pattern, 1), F.lit(" - "), extract(m, pattern, 2)),
    )


def _any_range(text: Column) -> Column:
    return F.coalesce(*[_range(text, p) for p in R.PRINTED_SPANS])


def labelled_period(text: Column) -> Column:
    """A range on a line that carries a period label; a same-month day range is spelled out."""
    def on_line(line):
        return F.coalesce(_any_range(line), days_of_a_month(line))

    labelled = F.filter(text_lines(text), lambda line: line.rlike(R.PERIOD_WORD))
    return first_of(F.transform(labelled, on_line))


def days_of_a_month(text: Column) -> Column:
    """``June 1-14, 2026`` -> ``June 1, 2026 - June 14, 2026``."""
    def spelled(match):
        first = collapse(F.replace(extract(match, R.DAYS_OF_A_MONTH, 1), F.lit("."), F.lit("")))
        month = F.regexp_replace(first, r"\s*\d+$", "")
        last, year = extract(match, R.DAYS_OF_A_MONTH, 2), extract(match, R.DAYS_OF_A_MONTH, 3)
        return F.concat(first, F.lit(", "), year, F.lit(" - "), month, F.lit(" "), last, F.lit(", "), year)

    return let(extract(text, R.DAYS_OF_A_MONTH, 0), spelled)


def billed_period(text: Column) -> Column:
    """The first two dates that stand side by side below the heading of the billed dates."""
    return let(extract(text, "(?is)" + R.BILLED + "(.*)$"), lambda rest: _range(rest, R.BILLED_SPAN))


def timecard_period(text: Column) -> Column:
    """The days really worked on a time card, not the window it was printed for."""
    worked = F.transform(hits(text, R.TIME_CARD_DAY, 1), lambda s: parse_date(s))
    return F.when(text.rlike(R.TIME_CARD), period_text(F.array_min(worked), F.array_max(worked)))


def long_range(text: Column) -> Column:
    """Two dates with spelled months, each with its year."""
    def spelled(match):
        return period_text(parse_date(extract(match, R.SPELLED_SPAN, 1)), parse_date(extract(match, R.SPELLED_SPAN, 2)))

    return let(extract(text, R.SPELLED_SPAN, 0), spelled)


def shared_year_range(text: Column) -> Column:
    """Two dates with spelled months, of which only the second carries the year."""
    def spelled(match):
        first, second = extract(match, R.SPAN_OF_ONE_YEAR, 1), extract(match, R.SPAN_OF_ONE_YEAR, 2)
        dated = F.concat_ws(" ", F.replace(first, F.lit("."), F.lit("")), extract(second, r"(\d{4})$"))
        return period_text(parse_date(dated), parse_date(second))

    return let(extract(text, R.SPAN_OF_ONE_YEAR, 0), spelled)


def month_named(text: Column, pattern: str) -> Column:
    """The whole calendar month a pattern names."""
    return let(extract(text, pattern, 0), lambda m: full_month(extract(m, pattern, 1), extract(m, pattern, 2)))


def header_month(text: Column) -> Column:
    """A month named above the first line that holds an amount, however long the letterhead is."""
    def above(lines):
        first = F.array_position(F.transform(lines, lambda s: s.rlike(P.MONEY) | s.rlike(P.RATE_LINE)), F.lit(True))
        return F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines)

    return month_named(F.array_join(let(text_lines(text), above), "\n"), R.BARE_MONTH)


def header_period(text: Column) -> Column:
    """``struct<period, labelled>``: precise, labelled sources first, whole months last."""
    labelled = F.coalesce(labelled_period(text), billed_period(text), timecard_period(text))
    precise = F.coalesce(long_range(text), shared_year_range(text), _any_range(text))
    month_of = month_named(text, R.MONTH_OF)
    loose = F.coalesce(month_named(text, R.MONTH_OF_SERVICE), header_month(text))

    def answer(period, is_labelled):
        return F.when(period.isNotNull(), F.struct(period.alias("period"), F.lit(is_labelled).alias("labelled")))

    return F.coalesce(
        let(labelled, lambda p: answer(p, True)), let(precise, lambda p: answer(p, False)),
        let(month_of, lambda p: answer(p, True)), let(loose, lambda p: answer(p, False)),
        F.struct(F.lit(None).cast("string").alias("period"), F.lit(False).alias("labelled")),
    )


# --- person names ---------------------------------------------------------------------------------------
_PARTICLE = "(?:" + "|".join(P.PARTICLES) + ")"


_TOKEN = r"[\w'’.\-]"


def _folded(words: tuple[str, ...]) -> str:
    """Any of the words in any case; the Kelvin sign is a k in lower case."""
    def letter(ch):
        return f"[{ch}{ch.upper()}" + ("K]" if ch == "k" else "]")

    return "(?:" + "|".join("".join(map(letter, w)) for w in sorted(words, key=len, reverse=True)) + ")"


_ENDS = rf"(?!{_TOKEN})"
_ANY_PARTICLE = _folded(P.PARTICLES) + _ENDS
#: A capitalised word between dots that is an initial or has small letters, and is none of the words that names never are.
_NAME_WORD = rf"\.*+(?=\p{{Lu}})(?!{_folded(P.NOT_NAMES)}\.*+{_ENDS})(?:\p{{Lu}}\.*+{_ENDS}|{_TOKEN}*?\p{{Ll}})"
_NO_NAME = rf"(?U)(?<!{_TOKEN})(?!{_ANY_PARTICLE}|{_NAME_WORD}){_TOKEN}++"
_CAPITAL_PARTICLE = rf"(?U)(?<!{_TOKEN})(?=\p{{Alpha}}*?\p{{Lu}})(?={_ANY_PARTICLE})(?!{_NAME_WORD})"
_CUT = "\u0001"


def _cut_at(text: Column, pattern: str) -> Column:
    """The parts of a text between matches; ``split`` would compile a pattern that is no single character anew for every row."""
    return F.split(F.regexp_replace(F.translate(text, _CUT, "\u0002"), pattern, _CUT), _CUT)


def _trimmed_run(run: Column) -> Column:
    """A run of name words without particles at its ends, when two to four words remain."""
    text = F.regexp_replace(run, rf"(?i)^(?:{_PARTICLE}(?: |$))+", "")
    text = F.regexp_replace(text, rf"(?i)(?:(?: |^){_PARTICLE})+$", "")
    return let(text, lambda t: F.when((t != "") & F.size(F.split(t, " ")).between(2, 4), t))


def _small_particles(run: Column) -> Column:
    """Particles inside a run in lower case, which only those printed in capitals are not yet."""
    def small(token):
        return F.when(F.lower(token).isin(*P.PARTICLES) & ~token.rlike(rf"(?U)^{_NAME_WORD}"), F.lower(token)).otherwise(token)

    return F.when(run.rlike(_CAPITAL_PARTICLE), F.array_join(F.transform(F.split(run, " "), small), " ")).otherwise(run)


def best_name(text: Column) -> Column:
    """The first run of two to four capitalised words; particles may stand inside a run.

    The text is cut at every word that belongs to no name, in one pass; what is left between cuts are the runs.
    """
    runs = F.filter(_cut_at(text, _NO_NAME), lambda r: r.rlike(r"\p{Lu}"))

    def name(run):
        bare = F.regexp_replace(F.regexp_replace(run, rf"(?U)[^\w'’.\-]+", " "), "^ | $", "")
        return let(bare, lambda r: _trimmed_run(_small_particles(r)))

    return first_of(F.transform(runs, name))


def person_name(raw: Column) -> Column:
    """A person's name in a longer description.

    Inside parentheses first, then after a connector, then next to the dates (after the last, before the
    first), then anywhere.
    """
    def find(s):
        def beside(fragments):
            return F.when(F.size(fragments) > 1, F.coalesce(best_name(F.element_at(fragments, -1)), best_name(F.element_at(fragments, 1))))

        # Every date has a digit.
        dated = F.when(s.rlike(r"\d"), let(_cut_at(s, R.DATE_IN_TEXT), beside))
        return F.coalesce(
            first_of(F.transform(hits(s, r"\(([^)]*)\)", 1), lambda inner: best_name(inner))),
            best_name(extract(s, P.NAME_CONNECTOR)),
            dated,
            best_name(s),
        )

    return let(strip(F.replace(raw, F.lit("\n"), F.lit(" "))), find)


def name_from_cell(cell: Column) -> Column:
    """The person's name, else the cell without titles and anything from a date on."""
    def plain(c):
        untitled = F.regexp_replace(c, r"(?i)\b(Mr|Ms|Mrs|Dr)\.?\s*", "")
        return strip(F.regexp_replace(untitled, r"(?s)\d{1,2}[/-].*$", ""))

    return let(cell, lambda c: F.coalesce(person_name(c), plain(c)))


def period_in(text: Column) -> tuple[Column, Column]:
    """The first two dates of a description."""
    found = hits(text, P.DATE_TOKEN)
    return parse_date(F.get(found, F.lit(0))), parse_date(F.get(found, F.lit(1)))


# --- totals and vendors of goods and services ---------------------------------------------------------
def labelled_amount(text: Column, label: str) -> Column:
    """The amount after a label; of several the last."""
    return clean_number(F.try_element_at(hits(text, "(?i)" + label + P.LABELLED_MONEY, 1), F.lit(-1)))


def plain_total(text: Column) -> Column:
    """The last amount of the last line that speaks of a total of the whole invoice."""
    lines = F.filter(text_lines(text), lambda s: s.rlike(P.TOTAL_WORD) & ~s.rlike(P.NOT_WHOLE_TOTAL))
    amounts = F.filter(F.transform(lines, lambda s: F.try_element_at(hits(s, P.MONEY_IN_LINE, 1), F.lit(-1))), lambda a: a.isNotNull())
    return clean_number(F.try_element_at(amounts, F.lit(-1)))


def service_total(text: Column) -> Column:
    """An explicit whole-invoice total, then a plain total line, then what is due."""
    return F.coalesce(
        *[labelled_amount(text, label) for label in P.WHOLE_TOTAL_LABELS],
        plain_total(text),
        *[labelled_amount(text, label) for label in P.DUE_LABELS],
    )


def _entity(text: Column) -> Column:
    """A company name cut after its legal form."""
    def cut(s):
        form = F.regexp_extract(s, "(?s)^(.*?" + P.LEGAL_FORM.replace("(?i)", "(?i:", 1) + "))", 1)
        name = collapse(F.regexp_replace(F.when(form != "", form).otherwise(s), r"^[ ,.\-]+|[ ,.\-]+$", ""))
        return F.when(name.rlike("[A-Za-z]") & (F.length(name) >= 3), name)

    return let(F.regexp_replace(text, r"^[ ,.\-]+|[ ,.\-]+$", ""), cut)


def service_vendor(text: Column, customer_pattern: str | None = None) -> Column:
    """A labelled seller that names a legal entity, else the first letterhead line that does."""
    lines = text_lines(text)

    def labelled(line):
        value = F.regexp_replace(extract(line, P.VENDOR_LABEL), P.BUYER_LABEL + r".*$", "")
        return let(value, lambda v: F.when(v.rlike(P.LEGAL_FORM), _entity(v)))

    def letterhead(line):
        usable = (line != "") & ~line.rlike(P.DOCUMENT_TITLE) & line.rlike(P.LEGAL_FORM)
        if customer_pattern:
            usable = usable & ~line.rlike("(?i)" + customer_pattern)
        return F.when(usable, _entity(line))

    return F.coalesce(
        first_of(F.transform(lines, labelled)), first_of(F.transform(lines, lambda line: letterhead(strip(line))))
    )


def email_brands(text: Column) -> Column:
    """Brand labels of e-mail domains in order, without personal and bank domains, in the case the text uses."""
    labels = F.filter(
        F.array_distinct(F.transform(hits(text, P.EMAIL_DOMAIN, 1), lambda s: F.lower(s))),
        lambda s: (F.length(s) >= 3) & ~s.isin(*P.NOT_VENDORS),
    )

    def cased(label):
        quoted = F.concat(F.lit(r"(?i)(?<!@)\b\Q"), label, F.lit(r"\E\b"))
        seen = F.regexp_extract_all(text, quoted, F.lit(0))
        with_capital = F.filter(seen, lambda w: w.rlike(r"\p{Lu}"))
        return F.coalesce(
            F.get(with_capital, F.lit(0)), F.get(seen, F.lit(0)),
            F.concat(F.upper(F.substring(label, 1, 1)), F.substr(label, F.lit(2))),
        )

    return F.transform(labels, cased)


