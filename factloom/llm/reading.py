"""Reading level of documents by a linear pairwise ranker with isotonic calibration.

Words and word pairs get a grade from the passages that hold them, and a text
is described by the grades of its words and pairs (vocabulary and phrasing) and
by its syntax: lengths of sentences and clauses, subordination, passives,
negation, lengths of words.  A linear ranker learns from pairs of graded
passages which one is the more demanding; isotonic regression turns its scores
into levels on the scale of the passages.

Only the graded passages are collected, which people grade by hand; their
number is checked against a bound.  The fitted model is a few arrays and two
dictionaries whose size follows from those passages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most graded passages to fit on.
MOST_PASSAGES = 20_000
#: Parts of the passages, each of which is scored by a ranker of the others for the calibration.
FOLDS = 5
#: Pseudo-passages at the middle grade behind the grade of a word or pair.
PRIOR, PRIOR_VARIANCE = 1.0, 2.0
#: Characters of the texts that a worker takes apart at once; a longer text is taken whole.
TOGETHER = 1 << 20
#: More than the different words of the passages can be.
PAIR = 1 << 31

# Words that open clauses, and forms of the passive and of modality.
SUBORDINATORS = frozenset(
    "although as because before by for if in inasmuch lest notwithstanding since so than that though unless until upon whereas whereby wherein whether which while who whom whose with".split()
)
AUXILIARIES = frozenset("be been being had has have is may might must ought should was were would could cannot".split())
NEGATIONS = frozenset("far hardly less merely neither never no none nor not save scarcely without".split())

_NOTE = re.compile(r"\[\d+\]|\(\s*(?:p|pp|c|ca)\.[^)]*\)")
_BULLET = re.compile(r"(?m)^\s*(?:\d+[.)]|[*•–-])\s+")
_END = re.compile(r"[.!?]+(?:\s+|$)|\n+")
# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = frozenset("Dr Mr Mrs Ms St Prof Rev No ca vol cf ed".split())
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def _sentences(text: str) -> list[str]:
    """Parts between full stops and line ends, where no initial or abbreviation stands before the stop."""
    out, start = [], 0
    for end in _END.finditer(text):
        part = text[start : end.start()]
        last = part[part.rfind(" ") + 1 :]
        if end.group()[0] != "\n" and (last[-1:].isupper() and len(last) < 3 or last in ABBREVIATIONS):
            continue
        out.append(part)
        start = end.end()
    return [*out, text[start:]]


# Fixed value: small words that join the parts of a name.
JOINTS = frozenset("and by de for in of on the van".split())


#: A name in the words of a sentence, which begins a line: no capital alone before a small word at its start.
_NAME = regex.compile(
    rf"(?m)(?:(?<= )|^(?!\p{{Lu}}\S*+ \P{{Lu}}))\p{{Lu}}\S*+(?:(?: (?:{'|'.join(sorted(JOINTS))})(?= )){{0,2}} \p{{Lu}}\S*+)*+"
)
_MARK = "\0"


def words_of(text: str) -> tuple[list[str], int]:
    """The words in lower case, with an empty string for each name, and the number of sentences.

    A name is a run of capitalised words, with up to two joints between them.  A
    capital at the start of a sentence makes no name if a small word follows.
    """
    lines = [" ".join(words) for sentence in _sentences(text) if (words := _WORD.findall(sentence))]
    marked = _NAME.sub(_MARK, "\n".join(lines)).lower().replace("\n", " ")
    return [w if w != _MARK else "" for w in marked.split(" ")] if lines else [], len(lines)


def _plain(text: str) -> str:
    return _BULLET.sub("", _NOTE.sub(" ", text))


def syntax(text: str, words: Sequence[str], sentences: int) -> list[float]:
    """Features of syntax and word length; all are means or shares, so length as such plays no part."""
    count = Counter(words)
    names = count.pop("", 0)
    n = max(sum(count.values()), 1)
    share = lambda group: sum(count[w] for w in group if w in count) / n
    lengths = np.array([(len(w), k) for w, k in count.items()] or [(0, 1)], dtype=float)
    of = lambda least: float(lengths[lengths[:, 0] >= least, 1].sum() / n)
    marks = text.count(",") + text.count(";") + text.count(":")
    whole = n + names
    return [
        float(np.log1p(whole / max(sentences, 1))), float(np.log1p(whole / (max(sentences, 1) + marks))), marks / n,
        share(SUBORDINATORS), share(AUXILIARIES), share(NEGATIONS), count["and"] / n,
        float(lengths[:, 0] @ lengths[:, 1] / n), of(7), of(10), of(13), len(count) / n,
    ]


#: What syntax asks of a word, as bits.
_GROUPS = [SUBORDINATORS, AUXILIARIES, NEGATIONS, frozenset(["and"])]
_BITS = {w: sum(1 << i for i, group in enumerate(_GROUPS) if w in group) for w in frozenset().union(*_GROUPS)}


def _syntax_of_batch(plains: Sequence[str], parsed: Sequence[tuple[list[str], int]], bits: np.ndarray, lengths: np.ndarray, of: np.ndarray, single: np.ndarray) -> np.ndarray:
    """:func:`syntax` of many texts at once, one row each; of every word its bits, length, text, and whether it is a word or a name."""
    rows = len(plains)
    total = lambda values: np.bincount(of, values, rows)
    words = np.maximum(total(single), 1)
    whole = words + total(~single)
    sentences = np.array([max(n, 1) for _, n in parsed])
    marks = np.array([p.count(",") + p.count(";") + p.count(":") for p in plains])
    distinct = np.array([len(d := set(ws)) - ("" in d) for ws, _ in parsed])
    return np.column_stack([
        np.log1p(whole / sentences), np.log1p(whole / (sentences + marks)), marks / words, *[total(bits >> i & 1) / words for i in range(len(_GROUPS))],
        total(lengths) / words, *[total(lengths >= least) / words for least in (7, 10, 13)], distinct / words,
    ])


class Grades:
    """Grades of keys, from the bands of the passages that hold them.

    A key's grade is the mean band of its passages and its weight falls with
    their variance: words of any text say little, words of one band much.  An
    unknown key has the middle grade and the least weight.
    """

    def __init__(self, lists: Sequence[np.ndarray], bands: np.ndarray) -> None:
        keys, at = np.unique(np.concatenate([np.unique(x) for x in lists]), return_inverse=True)
        of = np.repeat(bands, [len(np.unique(x)) for x in lists])
        self.keys = keys
        self.middle = (bands.min() + bands.max()) / 2
        self.moments = np.vstack([np.bincount(at, w, len(keys)) for w in (np.ones_like(of), of, of**2)] if len(keys) else np.zeros((3, 0)))
        self.table = self._table(self.moments)

    def _table(self, moments: np.ndarray) -> np.ndarray:
        """Rows grade and weight, with a last column for unknown keys."""
        count, total, square = (np.append(m, 0.0) for m in moments)
        count, total = count + PRIOR, total + PRIOR * self.middle
        square = square + PRIOR * (self.middle**2 + PRIOR_VARIANCE)
        grade = total / count
        return np.vstack([grade, 1 / (0.1 + square / count - grade**2)])

    def of_batch(self, keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """:meth:`features` of ``n`` texts at once, one row each; ``text`` is the number of the text that a key stands in."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        at = np.where(self.keys[at] == keys, at, len(self.keys)) if len(self.keys) else np.zeros(len(keys), dtype=np.int64)
        grade, weight = self.table[:, at]
        per_text = lambda values: np.bincount(text, values, n)
        some = per_text(np.ones(len(keys))) > 0
        whole, count = np.where(some, per_text(weight), 1.0), np.where(some, per_text(np.ones(len(keys))), 1.0)
        means = np.column_stack([per_text(grade * weight) / whole, per_text(grade) / count])
        means[~some] = self.middle
        shares = [per_text(weight * (grade < self.middle - 0.75)) / whole, per_text(weight * (grade > self.middle + 0.5)) / whole]
        return np.column_stack([means, *shares])

    def features(self, keys: np.ndarray, own: float | None = None) -> list[float]:
        """Weighted and plain mean grade, and the weighted shares of easy and of hard keys; ``own``: as if a passage of that band were unknown."""
        if not len(keys):
            return [self.middle, self.middle, 0.0, 0.0]
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != keys] = len(self.keys)
        if own is None:
            grade, weight = self.table[:, at]
        else:
            used, back = np.unique(at, return_inverse=True)
            known = used < len(self.keys)
            moments = np.zeros((3, len(used)))
            moments[:, known] = self.moments[:, used[known]] - np.array([[1.0], [own], [own**2]])
            grade, weight = self._table(moments)[:, :-1][:, back]
        whole = weight.sum()
        return [
            float(grade @ weight / whole), float(grade.mean()),
            float(weight[grade < self.middle - 0.75].sum() / whole), float(weight[grade > self.middle + 0.5].sum() / whole),
        ]


@dataclass(frozen=True)
class Model:
    """A fitted ranker; ``level`` of a text is on the scale of the graded passages."""

    ids: dict[str, int]
    words: Grades
    pairs: Grades
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # scores at which the calibrated level rises
    levels: np.ndarray
    low: int
    high: int

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """The score of every text; words and pairs are graded for many texts at once, as many as make up ``TOGETHER`` characters."""
        upto = np.cumsum([len(t) for t in texts])
        parts = np.split(np.arange(len(texts)), np.flatnonzero(np.diff(upto // TOGETHER)) + 1)
        return np.concatenate([self._scores([texts[i] for i in part]) for part in parts if len(part)] or [np.zeros(0)])

    def _scores(self, texts: Sequence[str]) -> np.ndarray:
        plains = [_plain(t) for t in texts]
        parsed = [words_of(p) for p in plains]
        n = len(texts)
        flat = list(chain.from_iterable(ws for ws, _ in parsed))
        of = np.repeat(np.arange(n), [len(ws) for ws, _ in parsed])
        # what is asked of a word is asked once for all its places
        code = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        at = np.fromiter(map(code.__getitem__, flat), dtype=np.int64, count=len(flat))
        ids, bits, lengths = (np.array(list(map(ask, code)), dtype=np.int64) for ask in (lambda w: self.ids.get(w, 1), lambda w: _BITS.get(w, 0), len))
        numbers = ids[at]
        pairs = numbers[:-1] * PAIR + numbers[1:]
        single, double = numbers > 0, (pairs > 0) & (of[:-1] == of[1:])
        x = np.column_stack([
            self.words.of_batch(numbers[single], of[single], n), self.pairs.of_batch(pairs[double], of[:-1][double], n),
            _syntax_of_batch(plains, parsed, bits[at], lengths[at], of, single),
        ])
        return ((x - self.centre) / self.spread) @ self.weights

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])

    def level(self, score: float) -> float:
        """Calibrated level, between the lowest and the highest band."""
        return float(np.interp(score, self.knots, self.levels))

    def band(self, score: float) -> int:
        return int(min(self.high, max(self.low, np.floor(self.level(score) + 0.5))))


def _keys(words: Sequence[str], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words (names apart) and of the pairs of neighbours; 0 is a name, 1 an unknown word."""
    numbers = np.array([ids.get(w, 1) for w in words], dtype=np.int64)
    pairs = numbers[:-1] * PAIR + numbers[1:]
    return numbers[numbers > 0], pairs[pairs > 0]


def _features(plain: str, words: Sequence[str], sentences: int, ids: dict[str, int], grades: Grades, pairs: Grades, own: float | None = None) -> list[float]:
    a, b = _keys(words, ids)
    return [*grades.features(a, own), *pairs.features(b, own), *syntax(plain, words, sentences)]


def rank(features: np.ndarray, bands: np.ndarray, penalty: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Weights that put the more demanding of two passages higher: logistic loss over all graded pairs.

    Pairs count by the inverse square of the distance of their grades, so that
    the close calls shape the scale.  The gradient is summed band against band,
    so memory stays at two bands' pairs.
    """
    levels = np.unique(bands)
    weights = np.zeros(features.shape[1])
    groups = [features[bands == b] for b in levels]
    moment, square = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        gradient, n = 2 * penalty * weights, 0
        scores = [g @ weights for g in groups]
        pull = np.zeros_like(weights)
        for i, low in enumerate(groups):
            for j in range(i + 1, len(groups)):
                p = 1 / (1 + np.exp(np.clip(scores[j][:, None] - scores[i][None, :], -30, 30)))
                near = 1 / (levels[j] - levels[i]) ** 2
                pull -= near * (p.sum(1) @ groups[j] - p.sum(0) @ low)
                n += near * p.size
        gradient = gradient + pull / max(n, 1)
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        weights = weights - 0.05 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    return weights


def isotonic(scores: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising levels that fit the bands in the order of the scores (pool adjacent violators): knots and levels."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first score, last score
    for s, b in zip(scores[order], bands[order], strict=True):
        blocks.append([float(b), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    knots = [x for b in blocks for x in (b[2], b[3])]
    levels = [b[0] / b[1] for b in blocks for _ in range(2)]
    return np.array(knots), np.array(levels)


def held_out_scores(features: np.ndarray, bands: np.ndarray, weights: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """The score of every passage by a ranker that has not seen it, on the scale of ``weights``; without enough passages by ``weights``.

    Folds take turns within a band, so every one has all bands.
    """
    order = np.lexsort((np.arange(len(bands)), bands))
    fold = np.empty(len(bands), dtype=np.int64)
    fold[order] = np.arange(len(bands)) % folds
    out = features @ weights
    for k in range(folds):
        rest = fold != k
        if len(np.unique(bands[rest])) == len(np.unique(bands)) and not rest.all():
            other = rank(features[rest], bands[rest])
            out[~rest] = features[~rest] @ other * (np.linalg.norm(weights) / max(np.linalg.norm(other), 1e-9))
    return out


def fit(texts: Sequence[str], bands: Sequence[int]) -> Model:
    """Fit the ranker and its calibration to graded passages.

    The grade of a passage's own words leaves that passage out, so that scores
    of passages and of new texts are alike, and the calibration sees each passage
    with the score of a ranker fitted on others.
    """
    bands_ = np.array(bands, dtype=float)
    plains = [_plain(t) for t in texts]
    parsed = [words_of(p) for p in plains]
    ids = {"": 0} | {w: i for i, w in enumerate(sorted({w for ws, _ in parsed for w in ws} - {""}), 2)}
    keys = [_keys(ws, ids) for ws, _ in parsed]
    words, pairs = (Grades([k[i] for k in keys], bands_) for i in (0, 1))
    raw = np.array([_features(p, ws, n, ids, words, pairs, b) for p, (ws, n), b in zip(plains, parsed, bands_, strict=True)])
    centre, spread = raw.mean(0), raw.std(0) + 1e-9
    x = (raw - centre) / spread
    weights = rank(x, bands_)
    knots, levels = isotonic(held_out_scores(x, bands_, weights), bands_)
    return Model(ids, words, pairs, centre, spread, weights, knots, levels, int(bands_.min()), int(bands_.max()))


def fit_table(passages: DataFrame, most: int = MOST_PASSAGES) -> Model:
    """Fit to a table with text and band; null text or band is left out.  More than ``most`` rows are an error, not a sample."""
    rows = passages.where("text is not null and band is not null").select("text", "band").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} graded passages; raise the bound")
    if len({r["band"] for r in rows}) < 2:
        raise ValueError("graded passages of at least two bands are needed")
    rows = sorted(rows, key=lambda r: (r["text"], r["band"]))
    return fit([r["text"] for r in rows], [r["band"] for r in rows])


_LEVEL = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("level", T.DoubleType()), T.StructField("band", T.IntegerType())])


def reading_level(spark, model: Model, text: Column) -> Column:
    """score, level and band of a whole text; null for null text and for text without words."""
    shared = spark.sparkContext.broadcast(model)  # as large as the graded passages

    @F.pandas_udf(_LEVEL)
    def levels(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        some = np.array([bool(t and _WORD.search(t)) for t in texts], dtype=bool)
        scores = np.full(len(texts), np.nan)
        if some.any():
            scores[some] = m.scores([t for t, s in zip(texts, some, strict=True) if s])
        level = np.where(some, np.interp(np.nan_to_num(scores), m.knots, m.levels), np.nan)
        band = pd.Series(np.clip(np.floor(np.nan_to_num(level) + 0.5), m.low, m.high).astype("int32")).astype("Int32").mask(~some)
        return pd.DataFrame({"score": pd.Series(scores).mask(~some), "level": pd.Series(level).mask(~some), "band": band})

    return levels(text)
