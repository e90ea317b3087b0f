import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from factloom.llm import reading as R

EASY, HARD = "cat dog sat ran big red hat sun cup map".split(), "methodological corroboration presupposed epistemology notwithstanding provenance stratification intelligible historiographical codification".split()


def passage(rng, band):
    words = [rng.choice(HARD if rng.random() < (band - 1) / 4 else EASY) for _ in range(80)]
    size = 3 + 4 * band
    return ". ".join(" ".join(words[i : i + size]).capitalize() for i in range(0, 80, size)) + "."


def test_held_out_passages_are_ranked():
    rng = random.Random(8)
    data = [(passage(rng, b), b) for b in range(1, 6) for _ in range(30)]
    rng.shuffle(data)
    model = R.fit([t for t, _ in data[:100]], [b for _, b in data[:100]])
    got = [(model.band(model.score(t)), b) for t, b in data[100:]]
    assert all(abs(g - b) <= 1 for g, b in got) and sum((g >= 4) == (b >= 4) for g, b in got) / len(got) > 0.85


def test_isotonic_rises_and_fits():
    knots, levels = R.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([1.0, 3, 2, 4, 5]))
    assert (np.diff(levels) >= 0).all() and np.interp(2.5, knots, levels) == 2.5 and np.interp(9, knots, levels) == 5


def test_words_and_sentences():
    words, sentences = R.words_of("Dr. E. P. Ada Lovelace of London sat. Then she ran\n1 more line")
    assert words == ["", "sat", "then", "she", "ran", "more", "line"] and sentences == 3
    assert R.words_of("") == ([], 0)


def test_table_and_edges(spark):
    rng = random.Random(1)
    rows = [(passage(rng, b), b) for b in (1, 5) for _ in range(12)] + [(None, 3), ("text", None)]
    passages = spark.createDataFrame(rows, "text string, band long")
    model = R.fit_table(passages)
    docs = spark.createDataFrame([(1, passage(rng, 1)), (2, passage(rng, 5)), (3, ""), (4, None), (5, "12 34 !!"), (6, passage(rng, 5) * 300)], "id long, text string")
    got = {r["id"]: r["r"] for r in docs.withColumn("r", R.reading_level(spark, model, docs["text"])).collect()}
    assert got[1]["band"] == 1 and got[2]["band"] == 5 and got[6]["band"] == 5 and all(got[i]["band"] is None and got[i]["level"] is None for i in (3, 4, 5))
    with pytest.raises(ValueError):
        R.fit_table(passages, most=5)
    with pytest.raises(ValueError):
        R.fit_table(passages.where("band = 1"))


@pytest.mark.parametrize("together", [1, 700, 1 << 20])
def test_texts_scored_together_are_scored_as_one_by_one(monkeypatch, together):
    monkeypatch.setattr(R, "TOGETHER", together)
    rng = random.Random(3)
    model = R.fit([passage(rng, b) for b in (1, 3, 5) for _ in range(8)], [b for b in (1, 3, 5) for _ in range(8)])
    texts = [passage(rng, rng.choice([1, 2, 5])) for _ in range(20)] + ["", "12", "Ada Lovelace", "cat", "unknown words, only; here: and there"]
    for t, score in zip(texts, model.scores(texts), strict=True):
        plain = R._plain(t)
        words, n = R.words_of(plain)
        x = R._features(plain, words, n, model.ids, model.words, model.pairs)
        assert score == pytest.approx(float(((np.array(x) - model.centre) / model.spread) @ model.weights), abs=1e-9)


DATA = "/root/testdata/sf0.001/graded_passages.parquet"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_held_out_accuracy_on_the_graded_passages():
    passages = pd.read_parquet(DATA).sample(frac=1, random_state=5)
    texts, bands = list(passages["text"]), list(passages["band"])
    right = near = hard = 0
    for k in range(5):
        model = R.fit([t for i, t in enumerate(texts) if i % 5 != k], [b for i, b in enumerate(bands) if i % 5 != k])
        for i in range(k, len(texts), 5):
            got = model.band(model.score(texts[i]))
            right, near, hard = right + (got == bands[i]), near + (abs(got - bands[i]) <= 1), hard + ((got >= 4) == (bands[i] >= 4))
    print(right / len(texts), near / len(texts), hard / len(texts))
    assert right / len(texts) >= 0.85 and near == len(texts) and hard / len(texts) >= 0.97
