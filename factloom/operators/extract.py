"""Text to claims over tables of documents: phrase patterns, and replies of a language model.

Spans of all matches cannot be had from SQL functions, so matching runs in
Python over Arrow batches, one document at a time and without a shuffle.  A
filter on the patterns' fixed words keeps documents that cannot match in the
JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.terms import TERM_DDL
from factloom.operators.ontology import Ontology
from factloom.operators.phrases import KINDS, Pattern, Template, iso_date, matches
from factloom.operators.replies import Chunk, Reader, Skip, UnreadableReply, build_prompt, describe, parse_claims, split_text

__all__ = [
    "KINDS", "Chunk", "Pattern", "Reader", "Skip", "Template", "UnreadableReply", "bare_triples", "build_prompt", "describe", "extract", "extract_with_model",
    "from_triples", "iso_date", "matches", "may_match", "parse_claims", "split_text",
]

#: Columns of a claim; ``chunk_offset`` is where the piece of the text begins that it was read from, ``ordinal`` its place among the claims of that piece.
CLAIM = {
    "subject": TERM_DDL, "predicate": "STRING", "object": TERM_DDL, "valid_from": "STRING", "valid_to": "STRING", "qualifiers": f"MAP<STRING, {TERM_DDL}>",
    "locator": "STRING", "quote": "STRING", "confidence": "DOUBLE", "extractor": "STRING", "chunk_offset": "INT", "ordinal": "INT", "error": "STRING",
}
REPORT = CLAIM | {"kind": "STRING", "reason": "STRING", "response": "STRING"}

# Letters that match an ASCII letter (s, k, i) where case plays no part, beside its two cases.
UNUSUAL_CASES = "\u017f\u212a\u0131\u0130"


def may_match(text: Column, patterns: Sequence[Pattern]) -> Column:
    """A condition that every document with a match meets: all fixed words of some pattern occur in it, or letters of unusual case."""
    folded, any_of = F.lower(text), F.lit(False)
    for p in patterns:
        all_of = F.lit(True)
        for w in p.words():
            if w.isascii():
                all_of = all_of & folded.contains(w.lower())
        any_of = any_of | all_of
    for letter in UNUSUAL_CASES:
        any_of = any_of | text.contains(letter)
    return any_of


def _by_document(documents: DataFrame, key: str, text: str, columns: dict[str, str], rows_of: Callable[[str], Iterator[dict]], condition: Column | None = None) -> DataFrame:
    """The rows that ``rows_of`` makes of each text that is not null, with the key of its document."""

    blank = dict.fromkeys(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [blank | {"__key": k} | row for k, t in zip(batch["__key"], batch["__text"], strict=True) for row in rows_of(t)]
            if rows:
                yield pd.DataFrame(rows, columns=["__key", *columns]).astype({"ordinal": "Int32", "chunk_offset": "Int32"})

    read = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where("__text is not null")
    if condition is not None:
        read = read.where(condition)
    ddl = ", ".join(f"{name} {kind}" for name, kind in {"__key": documents.schema[key].dataType.simpleString(), **columns}.items())
    return read.mapInPandas(run, ddl).withColumnRenamed("__key", key)


def extract(documents: DataFrame, patterns: Sequence[Pattern], key: str = "doc_id", text: str = "text", name: str = "pattern") -> DataFrame:
    """Claims that the patterns find in each document: ``key`` and the columns of a claim.

    Whole texts are read.  Null and empty texts have no claims.  A claim whose
    value cannot be read (an impossible date) comes out with ``error``.
    """
    patterns = list(patterns)

    def claims(t: str) -> Iterator[dict]:
        for i, claim in enumerate(matches(t, patterns)):
            yield claim | {"extractor": name, "chunk_offset": 0, "ordinal": i}

    return _by_document(documents, key, text, CLAIM, claims, may_match(F.col("__text"), patterns))


def extract_with_model(
    documents: DataFrame, complete: Callable[[str], str], ontology: Ontology | None = None, instructions: str = "", confidence: float | None = 0.6,
    require_quote: bool = True, max_chars: int | None = 12_000, key: str = "doc_id", text: str = "text", name: str = "llm",
) -> DataFrame:
    """Claims from a model's replies, chunk by chunk (``max_chars`` None: whole texts): ``key``, the columns of a claim, kind, reason, response.

    Rows of kind ``claim`` have a claim, of kind ``skipped`` the code of the
    reason why one was dropped, of kind ``response`` the raw reply; an unreadable
    reply is a skip of its own and costs no other chunk.  ``complete`` should
    answer a repeated prompt alike, for lost tasks run again.
    """

    def of_chunk(chunk: Chunk) -> Iterator[dict]:
        response = complete(build_prompt(chunk.text, ontology, instructions))
        yield {"kind": "response", "response": response}
        reader = Reader(chunk, ontology, confidence, require_quote)
        try:
            items = parse_claims(response)
        except UnreadableReply as e:
            yield {"kind": "skipped", "reason": str(e)}
            return
        for i, item in enumerate(items):
            try:
                yield reader.read(item) | {"kind": "claim", "ordinal": i}
            except Skip as why:
                yield {"kind": "skipped", "reason": str(why), "ordinal": i}

    def rows_of(t: str) -> Iterator[dict]:
        for offset, piece in split_text(t, max_chars):
            for row in of_chunk(Chunk(piece, offset)):
                yield row | {"extractor": name, "chunk_offset": offset}

    return _by_document(documents, key, text, REPORT, rows_of)


def bare_triples(claims: DataFrame) -> DataFrame:
    """subject, predicate and object texts of claims."""
    return claims.select(F.col("subject.text").alias("subject"), "predicate", F.col("object.text").alias("object"))


def from_triples(triples: DataFrame, evidence: Column, seq: Column) -> DataFrame:
    """Claims from bare triples (subject, predicate, object as text) and the evidence array for them; objects are strings."""
    none = F.lit(None).cast("string")
    text = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lit("string").alias("kind"), F.col(c).alias("text"), none.alias("hint")))
    return triples.select(
        seq.cast("long").alias("seq"), text("subject").alias("subject"), "predicate", text("object").alias("object"), evidence.alias("evidence"),
        none.alias("valid_from"), none.alias("valid_to"), F.expr(f"CAST(map() AS MAP<STRING, {TERM_DDL}>)").alias("qualifiers"),
    )
