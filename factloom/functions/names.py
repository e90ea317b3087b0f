"""Normalised names and readable entity ids."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Printable ASCII of Unicode category P.
_ASCII_PUNCTUATION = r"[!-#%-*,-/:;?@\[-\]_{}]"


def normalized(text: str) -> str:
    """Compatibility form, case folded, punctuation as blanks, single blanks, stripped."""
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join("".join(" " if unicodedata.category(c)[0] == "P" else c for c in folded).split())


@F.pandas_udf(T.StringType())
def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normalized(t))


def normalize(text: Column) -> Column:
    """Normalised name; null for null.  Plain ASCII never leaves the JVM; only other text goes to Python."""
    plain = text.rlike(r"^[\x20-\x7E]*$")
    native = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), _ASCII_PUNCTUATION, " "), " +", " "))
    return F.when(plain, native).otherwise(_normalized(F.when(~plain, text)))


def entity_id(normal_label: Column, normal_type: Column) -> Column:
    """``type:slug`` of a normalised label and type; ``entity`` for an empty slug, no prefix without a type."""
    slug = F.when(normal_label == "", "entity").otherwise(F.replace(normal_label, F.lit(" "), F.lit("-")))
    return F.when(F.coalesce(normal_type, F.lit("")) == "", slug).otherwise(F.concat(F.replace(normal_type, F.lit(" "), F.lit("-")), F.lit(":"), slug))


def humanized(predicate: Column) -> Column:
    """``BORN_IN`` as ``born in``."""
    return F.lower(F.btrim(F.replace(predicate, F.lit("_"), F.lit(" "))))


def predicate_name(text: Column) -> Column:
    """Runs of other than ASCII letters and digits as one underscore, stripped, upper case."""
    return F.upper(F.btrim(F.regexp_replace(text, "[^0-9A-Za-z]+", "_"), F.lit("_")))


def predicate_text(text: str) -> str:
    return re.sub("[^0-9A-Za-z]+", "_", text).strip("_").upper()
