import random
from collections import Counter, defaultdict

import pytest

from factloom.llm import packing
from factloom.llm.tokens import encoding, n_tokens

from pyspark.sql import functions as F


def check(rows, bins, assignment):
    capacity, tokens = dict(bins), {d: t for d, t in rows if t}
    largest = max(capacity.values())
    placed, by_bin = defaultdict(list), defaultdict(list)
    for r in assignment:
        placed[r["doc_id"]].append(r)
        by_bin[r["container"], r["bin_name"]].append(r)
    assert set(placed) == set(tokens)
    for d, pieces in placed.items():
        assert sum(p["size"] for p in pieces) == tokens[d] and sorted(p["piece"] for p in pieces) == list(range(pieces[0]["n_pieces"]))
        assert (len(pieces) > 1) == (tokens[d] > largest)
    assert len({c for c, _ in by_bin}) == len(by_bin)
    for (_, name), pieces in by_bin.items():
        spans = sorted((p["start"], p["start"] + p["size"]) for p in pieces)
        assert spans[-1][1] <= capacity[name] and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0
        assert capacity[name] == min(c for c in capacity.values() if c >= spans[-1][1])
    return sum(tokens.values()) / sum(capacity[n] for _, n in by_bin)


@pytest.mark.parametrize("bins", [[("s", 16)], [("s", 16), ("l", 64)]])
def test_every_document_is_placed_whole(spark, bins, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 3, 7, 7, 7, 9, 15, 16, 17, 40, 63, 64, 65, 200])) for i in range(900)]
    sized = spark.createDataFrame(rows, "doc_id long, tokens long").repartition(4)
    done = packing.pack(sized, bins)
    assert check(rows, bins, done.assignment.collect()) > 0.93
    used = packing.fill(done).agg(F.sum("used")).first()[0]
    assert used == sum(t for _, t in rows)


def test_too_long_documents_are_read_off_the_joint_packing(spark):
    bins = [("s", 16), ("l", 64), ("also_s", 16)]
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 9, 15, 16, 17, 40, 63, 64, 65, 128, 200])) for i in range(500)] + [(900, None)]
    done = packing.pack(spark.createDataFrame(rows, "doc_id long, tokens long").repartition(3), bins)
    found = packing.too_long(done, bins)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "ArrowEvalPython" in plan  # ranks and places are computed for it
    assert sorted(map(tuple, found.collect())) == sorted((n, d) for n, c in bins for d, t in rows if t and t > c)


def test_plan_is_best_fit_for_runs():
    plan = packing.Plan({10: 1_000_003, 6: 500_000, 4: 700_000}, {16: 16})
    count = Counter()
    for size, _, _, start, n in plan.places:
        count[size] += n
    assert count == {10: 1_000_003, 6: 500_000, 4: 700_000} and plan.containers < 1_080_000


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, tokens long")
    assert packing.pack(empty, [("s", 8)]).assignment.count() == 0 and packing.fill(packing.pack(empty, [("s", 8)])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, [("s", 0)])
    one = spark.createDataFrame([(1, 8), (2, None), (3, 0)], "doc_id long, tokens long")
    assert [r["doc_id"] for r in packing.pack(one, [("s", 8)]).assignment.collect()] == [1]


def test_tokens_of_whole_texts(spark):
    texts = ["", None, "Hello world", "Straße 漢字 🙂", "word " * 50_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(n_tokens(F.col("t"))).collect()]
    assert got == [len(encoding().encode_ordinary(t)) if t else 0 for t in texts]
    assert encoding().decode(encoding().encode_ordinary(texts[3])) == texts[3]
