"""How printed lines are read: a line is a row of parts, words as they are printed and values of a kind.

``line`` turns the parts into a Java regular expression with one group per value. Words match in any case with any blanks or none
between them; a value stands apart from the value before it by blanks. ``labels`` turns a table of labels into one expression.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- kinds of values ----------------------------------------------------------------------------------------
#: Digits, in groups of three or not, with a decimal part or without.
WHOLE = r"\d+(?:,\d+)*"
COUNT = r"\d+(?:\.\d+)?"
NUMBER = rf"{WHOLE}(?:\.\d+)?"
CENTS = rf"{WHOLE}\.\d{{2}}"
#: A person's name as printed, an item without digits or money, anything, the rest of a line, a unit of measure.
NAME = r"\p{Alpha}[\p{Alpha} .'\-]+?"
LONGEST_NAME = r"\p{Alpha}[\p{Alpha} .'\-]+"
ITEM = r"\p{Alpha}[^$\d\n]*?"
ANYTHING = r".+?"
REST = r".+"
UNIT = r"\p{Alpha}{2,4}"


@dataclass(frozen=True)
class Value:
    """A value to be read; ``ahead`` is what may stand directly before it, as a currency does (or must, if ``needed``). A value that may
    be ``flagged`` carries a letter behind it."""

    kind: str
    ahead: tuple[str, ...] = ()
    needed: bool = False
    flagged: bool = False


@dataclass(frozen=True)
class Maybe:
    """Parts that may be missing together."""

    parts: tuple


def maybe(*parts) -> Maybe:
    return Maybe(parts)


def words(text: str) -> str:
    """Printed words, with any blanks or none between them; a letter at an end is the end of a word."""
    found = text.split()
    inner = r"\s*".join(rf"\Q{word}\E" for word in found)
    return (r"\b" if found[0][0].isalnum() else "") + inner + (r"\b" if found[-1][-1].isalnum() else "")


def any_of(options: tuple[str, ...]) -> str:
    found = [words(o) for o in sorted(options, key=len, reverse=True)]
    if not all(f.startswith(r"\b") for f in found):
        return "(?:" + "|".join(found) + ")"
    # Where all begin with a letter or digit, that is looked at first: most places of a text begin none.
    first = "".join(sorted({o.split()[0][0] for o in options}))
    return rf"\b(?=[{first}])(?:" + "|".join(f[2:] for f in found) + ")"


def labels(options: tuple[str, ...], start: bool = False) -> str:
    """One of the labels, anywhere or at the start of a text."""
    return "(?i)" + (r"^\s*" if start else "") + any_of(options)


def _part(part) -> str:
    if not isinstance(part, Value):
        return words(part)
    ahead = rf"(?:{any_of(part.ahead)}\s*)" + ("" if part.needed else "?") if part.ahead else ""
    return f"{ahead}({part.kind})" + (r"\p{Alpha}?" if part.flagged else "")


def _parts(parts: tuple, blank: str, before=None) -> str:
    out = ""
    for part in parts:
        first = part.parts[0] if isinstance(part, Maybe) else part
        # Two values need a blank between them, words and signs stand by themselves.
        gap = "" if before is None and not out else f"{blank}+" if isinstance(first, Value) and isinstance(before, Value) else f"{blank}*"
        if isinstance(part, Maybe):
            out += f"(?:{gap}{_parts(part.parts, blank)})?"
        else:
            out += gap + _part(part)
            before = part
    return out


def line(*parts, whole: bool = False, blank: str = r"\s", numbered: bool = False) -> str:
    """The parts one after the other; ``whole``: they are a whole line, ``numbered``: with a number at its start that is not read."""
    start = rf"(?m)^{blank}*" if whole or numbered else ""
    number = rf"\d+{blank}+" if numbered else ""
    return f"(?i){start}{number}{_parts(parts, blank)}" + (f"{blank}*$" if whole else "")


def heading(*columns: tuple[str, ...], ordered: bool = True) -> str:
    """A line that names the columns, each by one of its words, in this order or in any."""
    if ordered:
        return "(?i)" + ".*".join(any_of(c) for c in columns)
    return "(?im)^" + "".join(f"(?=.*{any_of(c)})" for c in columns)
