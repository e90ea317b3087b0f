"""Replies of a language model: chunks of text to ask about, prompts, and the claims in an answer."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from functools import cached_property
from itertools import chain
from typing import Any

from factloom.functions.names import predicate_text
from factloom.operators.ontology import LITERALS, Ontology
from factloom.operators.phrases import term_of


def _breaks(text: str) -> list[tuple[list[int], list[int]]]:
    """Where a text may be divided, in one scan: starts and ends of paragraph breaks, of sentence ends, of blanks."""
    paragraphs, sentences, blanks = ([], []), ([], []), ([], [])

    def add(to: tuple[list[int], list[int]], start: int, end: int) -> None:
        to[0].append(start)
        to[1].append(end)

    newline, last = None, -2  # the newline before, if there is only white space since
    for m in re.finditer(r"\s", text):
        at = m.start()
        newline = newline if at == last + 1 else None
        add(blanks, at, at + 1)
        if at and text[at - 1] in ".!?":
            add(sentences, at - 1, at + 1)
        if m[0] == "\n":
            if newline is not None:
                add(paragraphs, newline, at + 1)
            newline = at
        last = at
    return [paragraphs, sentences, blanks]


def split_text(text: str, max_chars: int | None) -> list[tuple[int, str]]:
    """(offset, chunk) pieces of at most ``max_chars``, or the whole text for None.

    A piece ends after the last paragraph break within reach, else after the
    last sentence, else after the last blank, else at its limit; pieces without
    ink are dropped.
    """
    if max_chars is not None and max_chars < 1:
        raise ValueError("max_chars must be positive")
    size = len(text) if max_chars is None else max_chars
    breaks = _breaks(text) if len(text) > size else []
    out, at = [], 0
    while at < len(text):
        end = limit = min(at + size, len(text))
        if limit < len(text):
            reached = ((starts[k], ends[k]) for starts, ends in breaks if (k := bisect_right(ends, limit) - 1) >= 0)
            end = next((e for s, e in reached if s >= at), limit)
        if not text[at:end].isspace():
            out.append((at, text[at:end]))
        at = end
    return out


class UnreadableReply(ValueError):
    """A reply in which no claims can be found."""

    def __init__(self, response: str) -> None:
        super().__init__("reply.unreadable")
        self.response = response


def _parts(reply: str) -> Iterator[str]:
    """The fenced blocks of a reply, then all of it."""
    pieces = reply.split("```")
    for fenced in pieces[1 : len(pieces) - 1 : 2]:
        yield fenced.removeprefix("json")
    yield reply


def _containers(part: str) -> Iterator[Any]:
    """Every JSON list and object that begins in a text, also within others, by place."""
    read = json.JSONDecoder().raw_decode
    for opening in re.finditer(r"[\[{]", part):
        try:
            yield read(part, opening.start())[0]
        except (ValueError, RecursionError):
            continue


def parse_claims(response: str) -> list:
    """The claims of a reply: the first JSON list, object with a list of claims, or single claim, in fenced blocks before the rest."""
    for value in chain.from_iterable(map(_containers, _parts(response))):
        match value:
            case list():
                return value
            case {"claims": list(claims)}:
                return claims
            case {"subject": _}:
                return [value]
    raise UnreadableReply(response)


@dataclass(frozen=True)
class Chunk:
    """A piece of a text with its place in it."""

    text: str
    offset: int = 0

    @cached_property
    def _plain(self) -> tuple[str, list[int]]:
        """The text in lower case with single blanks, and where each of its characters stands."""
        kept, at = [], []
        for i, c in enumerate(self.text):
            c = " " if c.isspace() else low if len(low := c.lower()) == 1 else c
            if c != " " or not kept or kept[-1] != " ":
                kept.append(c)
                at.append(i)
        return "".join(kept), at

    def find(self, quote: str) -> tuple[int, int] | None:
        """Where a quote first stands, whatever its case and white space."""
        wanted, (plain, at) = Chunk(quote.strip())._plain[0], self._plain
        place = plain.find(wanted) if wanted else -1
        return None if place < 0 else (at[place], at[place + len(wanted) - 1] + 1)


class Skip(Exception):
    """Why a model's claim is dropped: a code such as ``subject.missing``."""


@dataclass(frozen=True)
class Reader:
    """Reads the claims of a reply about a chunk; each field has a method, in the order in which they may refuse a claim."""

    chunk: Chunk
    ontology: Ontology | None = None
    confidence: float | None = 0.6
    require_quote: bool = True

    FIELDS = ("subject", "predicate", "object", "quote", "confidence", "qualifiers", "times")

    def read(self, item: Any) -> dict:
        """One claim, checked; raises :class:`Skip` with the code of the first fault."""
        if not isinstance(item, dict):
            raise Skip("claim.not_an_object")
        claim: dict = {"error": None}
        for name in self.FIELDS:
            claim |= getattr(self, f"_{name}")(item, claim)
        return claim

    def _subject(self, item: dict, _: dict) -> dict:
        name, kind = item.get("subject"), item.get("subject_type")
        if not isinstance(name, str) or not name.strip():
            raise Skip("subject.missing")
        return {"subject": term_of(name.strip(), kind if isinstance(kind, str) and kind else None)}

    def _predicate(self, item: dict, _: dict) -> dict:
        raw = item.get("predicate")
        if not (name := predicate_text(raw) if isinstance(raw, str) else ""):
            raise Skip("predicate.missing")
        return {"predicate": name}

    def _object(self, item: dict, claim: dict) -> dict:
        value = item.get("object")
        if isinstance(value, (list, dict)):
            raise Skip("object.not_single")
        if value is None or isinstance(value, str) and not value.strip():
            raise Skip("object.missing")
        if not isinstance(value, str):
            return {"object": term_of(value)}
        stated = item.get("object_type")
        if isinstance(stated, str) and stated:
            wanted = stated
        else:
            defined = self.ontology.predicate(claim["predicate"]) if self.ontology else None
            wanted = defined.range if defined else None
        if convert := _PLAIN.get(wanted or ""):
            try:
                return {"object": term_of(convert(value.strip()))}
            except (ValueError, KeyError):
                raise Skip(f"object.not_{wanted}") from None
        return {"object": term_of(value.strip(), None if wanted in LITERALS else wanted)}

    def _quote(self, item: dict, _: dict) -> dict:
        quote = item.get("quote")
        span = self.chunk.find(quote) if isinstance(quote, str) else None
        if span:
            start, end = span
            return {"locator": f"chars {self.chunk.offset + start}-{self.chunk.offset + end}", "quote": self.chunk.text[start:end]}
        if self.require_quote:
            raise Skip("quote.not_in_text" if quote else "quote.missing")
        return {"locator": None, "quote": None}

    def _confidence(self, item: dict, _: dict) -> dict:
        given = item.get("confidence")
        usable = type(given) in (int, float) and 0 <= given <= 1
        return {"confidence": float(given) if usable else self.confidence}

    def _qualifiers(self, item: dict, _: dict) -> dict:
        given = item.get("qualifiers") or {}
        if not isinstance(given, dict):
            raise Skip("qualifiers.not_an_object")
        return {"qualifiers": {str(name): term_of(v) for name, v in given.items()}}

    def _times(self, item: dict, _: dict) -> dict:
        read = {name: _time(item[name]) if item.get(name) else None for name in ("valid_from", "valid_to")}
        if bad := [name for name, t in read.items() if t == ""]:
            raise Skip(f"{bad[0]}.not_a_time")
        return read


_TRUTH = {"true": True, "yes": True, "false": False, "no": False}
_PLAIN: dict[str, Callable[[str], Any]] = {
    "integer": lambda s: int(s.replace(",", "")), "number": lambda s: float(s.replace(",", "")), "boolean": lambda s: _TRUTH[s.lower()],
}


def _time(value: Any) -> str | None:
    """Text of a time or a year as a number; empty if it is no time."""
    text = f"{value:04d}" if type(value) is int else value if isinstance(value, str) else ""
    m = re.fullmatch(r"\s*(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:[Zz]|[+-]\d{2}:\d{2})?)?)?)?\s*", text)
    try:
        return text if m and date(int(m[1]), int(m[2] or 1), int(m[3] or 1)) else ""
    except ValueError:
        return ""


_PROMPT = """Read the text and list the factual claims it states, as JSON: {{"claims": [...]}}.
Each claim is an object with
  subject, subject_type{types}
  predicate{predicates}
  object, object_type (an entity type or one of {literals})
  valid_from, valid_to (YYYY, YYYY-MM or YYYY-MM-DD, or null)
  qualifiers (an object, may be empty)
  quote (copied from the text, word for word)
  confidence (0 to 1)
State nothing that the text does not. Write names in place of pronouns. Without claims, answer {{"claims": []}}.
{ontology}{instructions}
Text:
{text}
"""


def describe(ontology: Ontology) -> str:
    """The ontology as lines of a prompt."""
    lines = ["Entity types:"]
    for t in ontology.types.values():
        lines.append(f"- {t.name}" + (f" (a kind of {t.parent})" if t.parent else "") + (f": {t.description}" if t.description else ""))
    lines.append("Predicates:")
    for p in ontology.predicates.values():
        notes = ["one value at a time"] * (p.cardinality == "one") + ["a moment, valid_from only"] * (p.temporal == "moment") + [p.description] * bool(p.description)
        lines.append(f"- {p.name}: {' or '.join(p.domain) or 'anything'} -> {p.range or 'anything'}" + "".join(f"; {n}" for n in notes))
    return "\n".join(lines)


def build_prompt(text: str, ontology: Ontology | None = None, instructions: str = "") -> str:
    listed = ontology is not None and bool(ontology.predicates)
    return _PROMPT.format(
        types=" (one of those below)" if listed and ontology.types else " (or null)",
        predicates=" (one of those below)" if listed else " (in UPPER_SNAKE_CASE)",
        literals=", ".join(LITERALS), ontology=f"\n{describe(ontology)}\n" if listed else "",
        instructions=f"\n{instructions.strip()}\n" if instructions.strip() else "", text=text,
    )
