"""Phrase patterns: templates, the dates they read, and the claims that match in one text."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from typing import Any

from factloom.functions.terms import literal

# What the kinds of placeholder match, and the kinds of placeholders without one.
CAPITALS = "A-ZÀ-ÖØ-Þ"
QUOTES = "'’"
JOINERS = "of the and de del della der du da la le van von y".split()
NO_NAMES = (
    "A An And As At But By For From He Her Hers Him His However I In Is It Its My Of On Or Our She So "
    "That The Their Them Then There These They This Those To We When Where Which While Who You Your"
).split()
MONTHS = "january february march april may june july august september october november december".split()
_WORD = rf"(?:[{CAPITALS}]\.|[{CAPITALS}][\w{QUOTES}-]*)"
_NAME = rf"(?!(?:{'|'.join(NO_NAMES)})\b(?!\.)){_WORD}(?:(?:\s+(?:{'|'.join(JOINERS)}))*\s+{_WORD})*"
_MONTH = r"(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_DAY = r"\d{1,2}(?:st|nd|rd|th)?"
_DATE = rf"(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}-\d{{2}}|{_MONTH}\s+{_DAY},?\s+\d{{4}}|{_DAY}\s+{_MONTH}\s+\d{{4}}|{_MONTH}\s+\d{{4}}|\d{{4}})"
DEFAULT_KINDS = {"subject": "name", "object": "name", "valid_from": "date", "valid_to": "date"}

#: Orders of the parts of a date: y for a year, m for a month's name, d for a number of a day.
ORDERS = {"mdy", "dmy", "my"}


def _date_parts(text: str) -> Iterator[tuple[str, int]]:
    """Each token of a date as its part and value; ``?`` for what belongs to none."""
    before = ""
    for token in re.findall(r"\d+|[^\W\d_]+|[^\s.,]", text.lower()):
        part = "y" if token.isdigit() and len(token) == 4 else "d" if token.isdigit() else "?"
        value = int(token) if token.isdigit() else 0
        if part == "?" and len(token) > 2 and (named := [i for i, m in enumerate(MONTHS, 1) if m.startswith(token)]):
            part, value = "m", named[0]
        if not (before == "d" and token in ("st", "nd", "rd", "th")):
            yield part, value
        before = part


def iso_date(text: str) -> str:
    """A date in words at the precision stated, ``2 Feb. 1801`` as ``1801-02-02``; ISO text as it is; ValueError for anything else."""
    if re.fullmatch(r"\s*\d{4}(?:-\d{2}){0,2}\s*", text):
        return text.strip()
    parts = list(_date_parts(text))
    if "".join(p for p, _ in parts) not in ORDERS:
        raise ValueError(f"no date: {text!r}")
    at = dict(parts)
    return f"{at['y']:04d}-{at['m']:02d}" + (f"-{at['d']:02d}" if "d" in at else "")


@dataclass(frozen=True)
class Kind:
    """What a placeholder matches and how the match becomes a value."""

    expression: str
    convert: Callable[[str], Any] | None = None


KINDS = {
    "name": Kind(_NAME), "date": Kind(_DATE, iso_date), "year": Kind(r"\d{4}"), "word": Kind(rf"[\w{QUOTES}-]+"), "text": Kind(r"[^.;:!?\n]+"),
    "int": Kind(r"-?\d[\d,]*", lambda digits: int(digits.replace(",", ""))), "number": Kind(r"-?\d[\d,]*(?:\.\d+)?", lambda digits: float(digits.replace(",", ""))),
}

_HOLE = r"\{(?P<name>\w+)(?::(?P<kind>\w+))?\}"
_TOKENS = re.compile(rf"{_HOLE}|(?P<gap>\s+)|(?P<fixed>(?:(?!{_HOLE.replace('?P<name>', '').replace('?P<kind>', '')})\S)+)")


@dataclass(frozen=True)
class Template:
    """A phrasing such as ``{subject} was born in {object}``: fixed words, white space, and placeholders ``{name:kind}``."""

    text: str

    @cached_property
    def tokens(self) -> list[dict[str, str | None]]:
        return [m.groupdict() for m in _TOKENS.finditer(self.text)]

    @cached_property
    def holes(self) -> dict[str, str]:
        """The kind of every placeholder; ValueError if one is unknown, stands twice, or subject or object is missing."""
        named = [(t["name"], t["kind"] or DEFAULT_KINDS.get(t["name"], "text")) for t in self.tokens if t["name"]]
        kinds = dict(named)
        faults = [
            *(f"{{{n}}} more than once" for n in kinds if sum(n == m for m, _ in named) > 1),
            *(f"kind {k!r}, which is none of {sorted(KINDS)}" for k in kinds.values() if k not in KINDS),
            *(f"no {{{n}}}" for n in ("subject", "object") if n not in kinds),
        ]
        if faults:
            raise ValueError(f"{self.text!r} has {'; '.join(faults)}")
        return kinds

    @cached_property
    def words(self) -> list[str]:
        """What stands in every match, whatever its case."""
        return [t["fixed"] for t in self.tokens if t["fixed"]]

    @cached_property
    def expression(self) -> str:
        """Fixed words match in any case, white space matches white space, and no match begins or ends within a word."""
        holes = self.holes
        made = (
            f"(?P<{t['name']}>{KINDS[holes[t['name']]].expression})" if t["name"] else r"\s+" if t["gap"] else f"(?i:{re.escape(t['fixed'])})"
            for t in self.tokens
        )
        return rf"(?<![\w']){''.join(made)}(?![\w'])"

    @cached_property
    def converters(self) -> dict[str, Callable[[str], Any]]:
        return {name: KINDS[kind].convert for name, kind in self.holes.items() if KINDS[kind].convert}


@lru_cache(maxsize=1024)
def template_of(text: str) -> Template:
    """The template of a text, read once in a worker."""
    return Template(text)


@dataclass(frozen=True)
class Pattern:
    """A phrasing of a claim: a template, or with ``regex`` an expression with groups subject and object."""

    predicate: str
    template: str
    subject_type: str | None = None
    object_type: str | None = None
    confidence: float | None = 0.7
    regex: bool = False
    convert: Mapping[str, Callable[[str], Any]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.predicate:
            raise ValueError("a pattern needs a predicate")
        if not (self.confidence is None or 0 <= self.confidence <= 1):
            raise ValueError("confidence must lie within 0 and 1")
        if lacking := {"subject", "object"} - set(self.expression().groupindex):
            raise ValueError(f"{self.template!r} has no group {' or '.join(sorted(lacking))}")

    def expression(self) -> re.Pattern:
        return re.compile(self.template if self.regex else template_of(self.template).expression)

    def converters(self) -> dict[str, Callable[[str], Any]]:
        return ({} if self.regex else template_of(self.template).converters) | dict(self.convert)

    def words(self) -> list[str]:
        return [] if self.regex else template_of(self.template).words


class Spans:
    """Disjoint spans of a text, in order."""

    def __init__(self) -> None:
        self._starts: list[int] = []
        self._ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        """Add a span unless it overlaps one that is there; whether it was added."""
        at = bisect_left(self._starts, end)
        if at and self._ends[at - 1] > start:
            return False
        self._starts.insert(at, start)
        self._ends.insert(at, end)
        return True


def term_of(value: Any, hint: str | None = None) -> dict | None:
    """A term as a dictionary; text with a hint is a mention of an entity."""
    kind, text, _ = literal(value) or (None, None, None)
    if kind is None:
        return None
    return {"kind": "mention" if kind == "string" and hint else kind, "text": text, "hint": hint if kind == "string" else None}


def _claim(pattern: Pattern, match: re.Match, converters: Mapping[str, Callable[[str], Any]]) -> dict:
    values, faults = {}, []
    for name, raw in match.groupdict().items():
        if raw is not None:
            try:
                values[name] = converters.get(name, str)(raw.strip())
            except (ValueError, TypeError) as e:
                faults.append(str(e))
    subject, object_, begin, end = (values.pop(n, None) for n in ("subject", "object", "valid_from", "valid_to"))
    return {
        "subject": term_of(subject, pattern.subject_type), "predicate": pattern.predicate,
        "object": term_of(object_, pattern.object_type if isinstance(object_, str) else None), "valid_from": begin, "valid_to": end,
        "qualifiers": {name: term_of(v) for name, v in values.items()}, "locator": f"chars {match.start()}-{match.end()}",
        "quote": match[0], "confidence": pattern.confidence, "error": faults[-1] if faults else None,
    }


def matches(text: str, patterns: Sequence[Pattern]) -> list[dict]:
    """The claims that the patterns find in a text, by place.

    A match that overlaps one of an earlier pattern for the same predicate, or
    an earlier one of the same pattern, is dropped; list specific patterns
    first.  A value that cannot be converted makes a claim with an error.
    """
    taken = {p.predicate: Spans() for p in patterns}
    found = [
        (m.start(), rank, _claim(p, m, converters))
        for rank, p in enumerate(patterns)
        for converters in (p.converters(),)
        for m in p.expression().finditer(text)
        if taken[p.predicate].take(*m.span())
    ]
    return [claim for *_, claim in sorted(found, key=lambda f: f[:2])]
