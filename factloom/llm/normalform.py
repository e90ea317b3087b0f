"""One consistent form for text that looks the same but differs in its characters.

A transducer reads a text once, one grapheme cluster after the other: a base
with all its marks and the invisible characters among them, the longest match
there is.  Its table says for a cluster what it becomes, and what stands for it
in a word of each script.  The table follows from the Unicode data by rule:
compatibility forms (widths, ligatures, styled letters) become ordinary
characters, accents composed letters, every space U+0020, invisible characters
nothing; a look-alike letter has a counterpart in the scripts that draw it
alike.  What a word becomes is put out at its end, when the transducer knows
which scripts met in it.

The table of single characters and canonical sequences is made beforehand and
checked: no key has two outputs, no letter two counterparts in a script, and
the transducer leaves every output and every counterpart alone.  Clusters beyond
it (several marks on one letter) get their entry by the same rule when they
first occur.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters drawn alike, Latin first, then Cyrillic, then Greek ('.' for none).
LATIN = "ABCEHIJKMNOPSTXYZacehijnopsvxydqw"
CYRILLIC = "АВСЕНІЈКМ.ОРЅТХУ.асеһіј.орѕѵхуԁԛԝ"
GREEK = "ΑΒ.ΕΗΙ.ΚΜΝΟΡ.ΤΧΥΖα...ιϳ.ορ.νχ...."

# Characters without ink that are not of category Cf, and ranges of Cf that have ink.
EXTRA_INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
VISIBLE_FORMAT = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"
#: Breaks that are written as control characters, and separators of lines.
BREAKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\u2028\u2029"

#: Entries of the memo of a worker; older ones are dropped beyond it.
MEMO = 1 << 17

SCRIPTS = ("Latin", "Cyrillic", "Greek")


def _invisible(c: str) -> bool:
    if c in VISIBLE_FORMAT or c in BREAKS:
        return False
    return (
        unicodedata.category(c) in ("Cf", "Cc") or c in EXTRA_INVISIBLE
        or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef"
    )


def _assigned() -> Iterator[str]:
    """Assigned characters that are not unified ideographs, Hangul syllables, surrogates or of private use."""
    for start, end in ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x17000), (0x1A000, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200)):
        for code in range(start, end):
            c = chr(code)
            if unicodedata.category(c) not in ("Cn", "Cs", "Co"):
                yield c


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Key to output, by rule from the Unicode tables; raises if two rules disagree on a key."""
    out: dict[str, str] = {}

    def put(key: str, value: str) -> None:
        if out.setdefault(key, value) != value:
            raise ValueError(f"two outputs for {key!r}: {out[key]!r} and {value!r}")

    for c in _assigned():
        plain = unicodedata.normalize("NFKC", c)
        if _invisible(c):
            put(c, "")
        elif unicodedata.category(c) == "Zs" or c in BREAKS:
            put(c, " ")
        elif plain != c:
            put(c, "".join(x for x in plain if not _invisible(x)))
        elif len(apart := unicodedata.normalize("NFD", c)) > 1:
            put(apart, c)
            put(unicodedata.normalize("NFD", c[0])[:-1] + apart[-1], c)
    del out[" "]
    return out


@lru_cache(maxsize=1)
def _look_alikes() -> dict[str, dict[str, str]]:
    """By target script: letters of the other scripts to that script's letter."""
    to: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
    for row in zip(LATIN, CYRILLIC, GREEK, strict=True):
        for script, target in zip(SCRIPTS, row, strict=True):
            for other in row:
                if "." not in (target, other) and other != target and to[script].setdefault(other, target) != target:
                    raise ValueError(f"two look-alikes for {other!r}")
    return to


_SCRIPT = [regex.compile(rf"\p{{Script={s}}}") for s in SCRIPTS]
_OTHER_SCRIPT = regex.compile(r"(?=\p{L})[^\p{Script=Latin}\p{Script=Cyrillic}\p{Script=Greek}\p{Script=Common}\p{Script=Inherited}]", regex.V1)
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")


def scripts_of(text: str) -> int:
    """The scripts of the letters of a text as bits: those of ``SCRIPTS`` in order, then any other."""
    return sum(1 << i for i, p in enumerate([*_SCRIPT, _OTHER_SCRIPT]) if p.search(text))


def mixed(word: str) -> bool:
    """Whether letters of more than one script stand in ``word``."""
    return scripts_of(word).bit_count() > 1


class Atom(NamedTuple):
    """A part of an output: of a word or not, the scripts in it, and what stands for it in a word of each script (None: nothing does)."""

    text: str
    of_word: bool
    scripts: int
    in_script: tuple[str | None, ...]


def _atom(text: str) -> Atom:
    if not _LETTERS.fullmatch(text):
        return Atom(text, False, 0, ())
    apart, counterparts = unicodedata.normalize("NFD", text), []
    for i, script in enumerate(SCRIPTS):
        swapped = unicodedata.normalize("NFC", "".join(_look_alikes()[script].get(c, c) for c in apart))
        counterparts.append(swapped if scripts_of(swapped) in (0, 1 << i) else None)
    return Atom(text, True, scripts_of(text), tuple(counterparts))


def _by_rule(cluster: str) -> str:
    """What a cluster becomes: the rule that the table follows."""
    text, before = "".join(" " if c in BREAKS or unicodedata.category(c) == "Zs" else c for c in cluster), None
    while text != before:
        before, text = text, unicodedata.normalize("NFKC", "".join(c for c in text if not _invisible(c)))
    return text


def _class(characters: Iterable[str]) -> str:
    return "".join(f"\\U{ord(c):08x}" for c in characters)


class Transducer:
    """One pass over the grapheme clusters of a text; ``conflicts`` names the keys whose output or counterpart it would rewrite again."""

    def __init__(self, entries: Mapping[str, str]) -> None:
        self.entries = entries
        self._atoms: dict[str, tuple[Atom, ...]] = {}
        unseen = _class(c for c in _assigned() if _invisible(c))
        # parts of Hangul syllables, also in compatibility forms, come together with what is invisible between them
        hangul = r"\u1100-\u11ff\u3131-\u318e\ua960-\ua97f\ud7b0-\ud7ff\uffa1-\uffdc"
        self._cluster = regex.compile(rf"(?:[{hangul}][\p{{M}}{unseen}]*+)++|\X(?:[{unseen}]|[\p{{M}}\u1160-\u11ff])*+")

    def entry(self, cluster: str) -> tuple[Atom, ...]:
        if cluster not in self._atoms:
            if len(self._atoms) >= MEMO:
                self._atoms.clear()
            output = self.entries[cluster] if cluster in self.entries else _by_rule(cluster)
            self._atoms[cluster] = tuple(_atom(part) for part in regex.findall(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+", output))
        return self._atoms[cluster]

    def apply(self, text: str) -> tuple[str, bool]:
        """The form of a text, and whether a word in it still mixes scripts."""
        out: list[str] = []
        word: list[Atom] = []
        met, left = 0, False
        for cluster in self._cluster.findall(text):
            for atom in self.entry(cluster):
                if atom.of_word:
                    word.append(atom)
                    met |= atom.scripts
                else:
                    left |= self._end(word, met, out)
                    word, met = [], 0
                    out.append(atom.text)
        left |= self._end(word, met, out)
        return "".join(out), left

    @staticmethod
    def _end(word: list[Atom], met: int, out: list[str]) -> bool:
        """Put out a word, in the first script it has in which all of it can be written; whether there is none though scripts met."""
        if met.bit_count() > 1:
            for i in range(len(SCRIPTS)):
                if met >> i & 1 and all(a.in_script[i] is not None for a in word):
                    out.extend(a.in_script[i] for a in word)
                    return False
        out.extend(a.text for a in word)
        return met.bit_count() > 1

    def conflicts(self) -> list[str]:
        bad = []
        for key in self.entries:
            made = [self.apply(key)[0], *(c for a in self.entry(key) for c in a.in_script if c is not None)]
            if any(self.apply(m)[0] != m for m in made):
                bad.append(key)
        return bad


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer(mapping())


@lru_cache(maxsize=1)
def checked() -> Transducer:
    """The transducer, after a check of its whole table; made once where queries are built, not by every worker."""
    if found := transducer().conflicts():
        raise ValueError(f"outputs that are not in the form: {found[:5]!r}")
    return transducer()


_PIECE = regex.compile(r"\s+|\S+")


@lru_cache(maxsize=MEMO)
def _piece(piece: str) -> tuple[str, bool]:
    return transducer().apply(piece)


def read(text: str) -> tuple[str, bool]:
    """The consistent form of a text, and whether the text was in it: equal to it, with no word that mixes scripts."""
    if text.isascii() and text.isprintable():
        return text, True
    pieces = [_piece(p) for p in _PIECE.findall(text)]
    form = "".join(p for p, _ in pieces)
    return form, form == text and not any(left for _, left in pieces)


def normal_form(text: str | None) -> str | None:
    """The consistent form of a text; null stays null, empty stays empty.

    Letter case and spelling stay as they are, words wholly in another script
    too.  The result is in the form itself, unless a word mixes letters that
    have no look-alike (see :func:`in_form`).
    """
    return None if text is None else read(text)[0]


def in_form(text: str) -> bool:
    """Whether a text needs no change and none of its words mixes scripts."""
    return read(text)[1]


_FORM = T.StructType([T.StructField("form", T.StringType()), T.StructField("changed", T.BooleanType())])


@F.pandas_udf(_FORM)
def _forms(texts: pd.Series) -> pd.DataFrame:
    made = [(None, True) if t is None else read(t) for t in texts]
    return pd.DataFrame({"form": [f for f, _ in made], "changed": [not same for _, same in made]})


#: Characters that may need a change; text of printable ASCII alone is in the form and never leaves the JVM.
_BEYOND = "[^\\x20-\\x7E]"


def with_form(df: DataFrame, text: str, form: str = "form", changed: str = "changed") -> DataFrame:
    """Add the consistent form of column ``text`` and whether the text was not in it.

    Null text gives a null form and ``changed`` false; empty text stays empty.
    Any length is handled whole.  Existing columns named ``form`` or ``changed``
    are replaced, as with ``withColumns``.
    """
    checked()
    beyond: Column = F.when(F.col(text).rlike(_BEYOND), F.col(text))
    made = _forms(beyond)
    return df.withColumn("__made", made).withColumns(
        {form: F.coalesce(F.col("__made.form"), F.col(text)), changed: F.coalesce(F.col("__made.changed"), F.lit(False))}
    ).drop("__made")
