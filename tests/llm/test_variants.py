import itertools
import random

import pytest

import factloom.llm.components as C
from factloom.llm import names as N
from factloom.llm import variants as V
from factloom.llm.components import components

SCHEMA = "seq long, id string, label string, type string, aliases_json string, provisional boolean"

#: What the small tables of these tests cannot teach.
LEXICON = N.Lexicon(
    org=dict.fromkeys("royal first second college association academy marine cartography choral music peat ecology".split(), 0.1),
    place=dict.fromkeys("new north south heath port".split(), 0.1),
)

SAME = [
    [("Person", "Anthony Skestuthetut", None), ("Scientist", "Skestuthetut, Tony", "[]"), (None, "A. Skestuthetut", '["Antony Skestuthetut"]'), ("Person", "Dr Anthonу Skeѕtutthetut", "bad json")],
    [("Person", "Olivia Dorothy Trafeshofet Jr.", None), ("Person", "Trafeshofet, Liv, Junior", None)],
    [("Person", "Olivia Dorothy Trafeshofet Sr.", None)],
    [("Person", "Florence Skestuthetut", None), ("Person", "FLO SKESTUTHETUT", None)],
    [("Organization", "Royal Gritebeskux College of Marine Cartography", None), (None, "royal gritebeskux coll. of marine cartogaphy", '["RGCMC"]'), ("Organization", "College of Marine Cartography of Royal Gritebeskux", None), ("Organization", "RGCMC (Gritebeskux)", None)],
    [("Organization", "Royal Gritebeskux Association for Choral Music", None)],
    [("Organization", "First Tropatajun College of Peat Ecology", None)], [("Organization", "Second Tropatajun College of Peat Ecology", None)],
    [("Place", "New Wozidibar Heath", '["New Wozidibar Heath, Tarnshire"]'), ("Place", "Tarnshire: New Wozidibar Heath", None), ("Place", "Wozidibar Heath, New", '["New Wozidibr Heath, Tarnshire"]')],
    [("Place", "New Wozidibar Heath", '["New Wozidibar Heath, Sundmoor"]')],
    [("Place", "North Rijamovak", None), ("Place", "City of North Rijamovak", None)], [("Place", "South Rijamovak", None)],
    [("Person", None, None)], [("Person", "", "[]")], [("Place", "???", None)],
]


def test_variants_are_linked_and_namesakes_are_not(spark):
    rows, want, seq = [], set(), 0
    for group in SAME:
        ids = []
        for kind, label, alias in group:
            seq += 1
            ids.append(f"id{seq:03d}")
            rows.append((seq, ids[-1], label, kind, alias, False))
        want |= set(itertools.combinations(ids, 2))
    got = {tuple(r) for r in V.pairs_of(V.variants(spark.createDataFrame(rows, SCHEMA).repartition(3), LEXICON)).collect()}
    assert got == want
    assert V.variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_what_is_left_open_is_not_guessed(spark):
    rows = [(1, "a", "S. Pohuzusund", "Person", None, False), (2, "b", "Susannah Pohuzusund", "Person", None, False), (3, "c", "Samuel Pohuzusund", "Person", None, False),
            (4, "d", "Port Shekihezus", "Place", None, False), (5, "e", "Port Shekihezus, Sundmoor", "Place", None, False)]
    assert {tuple(r) for r in V.pairs_of(V.variants(spark.createDataFrame(rows, SCHEMA), LEXICON)).collect()} == {("d", "e")}


def test_a_swap_in_the_middle_of_eight_letters_is_met(spark):
    rows = [(1, "a", "Anthony Brumikat", "Person", None, False), (2, "b", "Anthony Bruimkat", "Person", None, False), (3, "c", "Anthony Brumskot", "Person", None, False)]
    a, b, c = (N.Lexicon().reader.record("Person", label, None) for _, _, label, *_ in rows)
    assert len(N.skeleton(a.cores[0])) == 8 and N.agree(a, b) and not N.agree(a, c)
    assert {tuple(r) for r in V.pairs_of(V.variants(spark.createDataFrame(rows, SCHEMA))).collect()} == {("a", "b")}


def typed(rng, word):
    i = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("aeotk") + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + "u" + word[i + 1 :]])


def one_slip(a, b):
    """A letter more, less, another, or two neighbours swapped."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return len(a) < 2 and len(b) < 2 or len(a) == len(b) == 2 and a == b[::-1]


@pytest.mark.parametrize("common", [64, 4, 1])
def test_clusters_are_those_of_all_pairs(spark, monkeypatch, common):
    """Whatever is discarded as overly common, no pair one slip apart is lost, and none is linked that a comparison of all with all would not link."""
    monkeypatch.setattr(V, "COMMON", common)
    rng = random.Random(6)
    cores = ["".join(rng.choice(["ska", "tri", "mo", "ve", "lun", "dro", "ki", "zu", "pe"]) for _ in range(4)) for _ in range(25)]
    rows = []
    for i in range(250):
        core = rng.choice(cores)
        rows.append((i, f"id{i:03d}", f"{rng.choice(['Anthony', 'Ursula'])} {(typed(rng, core) if rng.random() < 0.5 else core).capitalize()}", "Person", None, False))
    read = {i: N.Lexicon().reader.record("Person", label, None) for i, _, label, *_ in rows}
    truth = {(a, b) for a, b in itertools.combinations(sorted(read), 2) if N.agree(read[a], read[b])}
    df = spark.createDataFrame(rows, SCHEMA)
    cluster = {i: i for i in read}
    while changed := [(a, b) for a, b in truth if cluster[a] != cluster[b]]:
        for a, b in changed:
            cluster[a] = cluster[b] = min(cluster[a], cluster[b])
    want = {f"id{i:03d}": c for i, c in cluster.items() if sum(x == c for x in cluster.values()) > 1}
    got = {r["id"]: r["cluster"] for r in V.variants(df).collect()}
    for a, b in truth:
        if one_slip(*(N.skeleton(read[i].cores[0]) for i in (a, b))):
            assert got[f"id{a:03d}"] == got[f"id{b:03d}"]
    assert all(want[i] <= c and want[i] == want[f"id{c:03d}"] for i, c in got.items()) and len(got) > 200


#: A vocabulary of its own, none of whose words the library names.
BODIES, FIELDS, FRONTS = "zeppelin observatory kennel cooperative".split(), "falconry volcanoes saffron puppetry glaciers orchids".split(), "gilded jade northernmost".split()
GIVEN = "Gwendolyn Ibrahim Sigrid Takeshi Oluwaseun Marisol".split()


def foreign_table(seed, things=400):
    """Rows of bodies and persons of that vocabulary, each thing typed several times, and the thing of each id."""
    rng = random.Random(seed)
    coin = lambda: "".join(rng.choice(["ska", "tri", "mo", "ve", "lun", "dro", "ki", "zu", "pe", "hu", "ra"]) for _ in range(4))
    rows, thing = [], {}
    for t in range(things):
        core = coin()
        parts = [rng.choice(FRONTS), core, rng.choice(BODIES), "of", *rng.sample(FIELDS, 2)]
        person = f"{rng.choice(GIVEN)} {core.capitalize()}"
        for _ in range(rng.choice([1, 2, 3])):
            seq = len(rows)
            if t % 2:
                words = list(parts)
                at = rng.choice([0, 1, 2, 4, 5])
                words[at] = typed(rng, words[at]) if rng.random() < 0.5 else words[at]
                if rng.random() < 0.3:
                    words = [words[2], "of", words[4], words[5], words[0], words[1]]
                label, kind = " ".join(words).title(), "Organization"
            else:
                given, surname = person.split()
                given = typed(rng, given).capitalize() if rng.random() < 0.4 else given
                label, kind = rng.choice([f"{given} {surname}", f"{surname}, {given}", f"{given} {surname}".upper()]), "Person"
            rows.append((seq, f"id{seq:04d}", label, kind if rng.random() < 0.9 else None, None, False))
            thing[rows[-1][1]] = t
    return rows, thing


def test_words_of_names_are_learnt_from_the_table(spark):
    rows, thing = foreign_table(3)
    df = spark.createDataFrame(rows, SCHEMA)
    lexicon = V.learn(df)
    assert set(lexicon.org) >= {*BODIES, *FIELDS, *FRONTS} and set(lexicon.person) >= {g.lower() for g in GIVEN} and not lexicon.place
    want = {(a, b) for a, b in itertools.combinations(sorted(thing), 2) if thing[a] == thing[b]}
    got = {tuple(r) for r in V.pairs_of(V.variants(df, lexicon)).collect()}
    assert len(want) > 200 and len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.98
    assert V.learn(df.limit(0)) == N.Lexicon()


def test_a_name_of_common_words_alone_is_told_by_its_rarest():
    reader = N.Lexicon(org={"royal": 0.5, "gritebeskux": 0.3, "college": 0.6}).reader
    r = reader.record("Organization", "Royal Gritbeskux College", None)
    assert r.cores == ("gritebeskux",) and r.words == ("college", "royal")


def test_a_hot_name_is_one_node_and_one_cluster(spark):
    rng = random.Random(9)
    rows = [(i, f"id{i:04d}", "Henry Mumujashombrik" if rng.random() < 0.6 else f"Henry {typed(rng, 'mumujashombrik').capitalize()}", "Person", None, False) for i in range(400)]
    rows += [(1000 + i, f"x{i}", f"Henry {''.join(rng.choice(['ska', 'tri', 'mo', 've', 'lun']) for _ in range(5)).capitalize()}", "Person", None, False) for i in range(100)]
    sizes = [r["size"] for r in V.variants(spark.createDataFrame(rows, SCHEMA)).where("cluster < 1000").select("cluster", "size").distinct().collect()]
    assert max(sizes) >= 396


def test_no_side_is_broadcast_for_the_size_of_its_file(spark, monkeypatch):
    """Fragments are many times larger than the file they come from, by which Spark would choose."""
    plans, cut = [], V.cut
    note = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or df
    for module in (V, C):
        monkeypatch.setattr(module, "cut", lambda df: cut(note(df)))
    rows = [(i, f"id{i}", f"Henry {w}", "Person", None, False) for i, w in enumerate("Mumujashombrik Mumujashombri Mumujashonbrik Trelovagat".split())]
    assert note(V.pairs_of(V.variants(spark.createDataFrame(rows, SCHEMA)))).count() == 3
    assert sum("SortMergeJoin" in p for p in plans) >= 8 and not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in plans)


def test_longest_common_subsequence():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 80))) for _ in "ab")
        assert N.lcs(a, b) == plain(a, b)
    assert N.lcs_ratio("", "") == 0.0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 100)] + [(300, 300 + i) for i in range(1, 60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[200] == got[101] == 100 and {got[300 + i] for i in range(60)} == {300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
