"""Reading names as people type them: persons, organisations and places.

A name is brought to the consistent form, folded (case, accents, script) and
taken apart: its core (surname, or the coined word of a body or place) and what
stands around it.  Two records are of one thing if their cores agree by
longest common subsequence and the rest does not contradict.

Which words are those of many names ("institute", "north", a given name) and
which one names the thing itself is learnt from the table (:class:`Lexicon`): a
word of many different names of its kind is common, and the core is what is
not, or the rarest.  Fixed are only words of grammar, titles, abbreviations and
a dictionary of English nicknames.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from factloom.llm.normalform import normal_form

# Given names with the short forms and nicknames used for them.
NICKNAMES = """
abigail: abby gail nabby; alexander: alec alex alick sandy xander; anthony: tony ant; benjamin: ben benny benjy;
caroline: caro carrie lina; charles: charlie chas chuck; dorothy: dolly dora dot dottie; edward: ed eddie ned ted teddy;
elizabeth: bess beth betsy betty eliza lizzie libby liz lisa; florence: flo florrie flossie; frederick: fred freddie freddy;
george: georgie dod; henrietta: etta hattie hettie; henry: hal hank harry; isabella: bella belle ella isa izzy tibby;
james: jamie jem jim jimmy; john: jack johnny; joseph: joe joey; josephine: jo josie posy; katherine: kate kathy katie kay kit kitty;
lawrence: larry laurie law lawrie; margaret: daisy madge maggie marge meg peggy; mary: molly polly; michael: mick mickey mike;
nathaniel: nat nate nathan; nicholas: nick nicky klaus; olivia: liv livvy livia ollie; patrick: paddy pat; penelope: pen penny nell;
quentin: quin quinn; rebecca: beck becca becky; richard: dick rich rick ricky; robert: bob bobby rob robin; samuel: sam sammy;
susannah: sue suke suky susan susie; theodora: dora thea theo; thomas: tom tommy; ursula: ulla ursie; victor: vic; victoria: vicky vic tori;
wilhelmina: mina minnie wilma billie; william: bill billy will willie liam; zachary: zach zack zak
"""
# Words around names, and common abbreviations of words for bodies and places.
TITLES = frozenset("dr mr mrs ms miss prof professor rev reverend sir dame lady lord hon capt col st".split())
GENERATIONS = {"jr": "jr", "jun": "jr", "junior": "jr", "sr": "sr", "sen": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv"}
PARTICLES = frozenset("van von de del della der da di du la le ter ten den".split())
LINKS = frozenset("the of for and on by at in".split())
DROPPED = frozenset("limited".split())
SHORT_BODIES = {"bros": "brotherhood", "dept": "department", "inst": "institute", "univ": "university", "pr": "press", "co": "company", "ltd": "limited", "lab": "laboratory", "labs": "laboratory", "soc": "society", "assoc": "association", "acad": "academy", "coll": "college", "mus": "museum"}
SHORT_PLACES = {"mt": "mount", "ft": "fort", "pt": "port", "st": "saint", "lk": "lake", "br": "bridge", "hth": "heath", "gt": "great", "lt": "little", "nth": "north", "sth": "south", "upr": "upper", "lwr": "lower"}
PLACE_DROPPED = frozenset("city town village the of on by".split())
# Fixed value: the letters of a common romanisation.
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхц", "a b v g d e zh z i j k l m n o p r s t u f h c".split(), strict=True))

KINDS = {"Person": "person", "Scientist": "person", "Artist": "person", "Organization": "org", "Place": "place"}

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?")


def _nicknames() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for entry in NICKNAMES.replace("\n", " ").split(";"):
        formal, shorts = entry.split(":")
        for name in [formal.strip(), *shorts.split()]:
            out.setdefault(name, set()).add(formal.strip())
    return {k: frozenset(v) for k, v in out.items()}


GIVEN = _nicknames()
FORMAL = sorted({f for v in GIVEN.values() for f in v})


@lru_cache(maxsize=1 << 16)
def fold(text: str) -> str:
    """Lower case, without accents, in Latin letters, on top of the consistent form; case marks of initials are gone too."""
    if text.isascii() and text.isprintable():
        return text.lower()
    apart = unicodedata.normalize("NFD", normal_form(text).lower().replace("й", "j"))
    plain = "".join(c for c in apart if not unicodedata.combining(c))
    return plain if plain.isascii() else "".join(CYRILLIC.get(c, c) for c in plain)


def skeleton(word: str) -> str:
    """A word as it sounds: letters that are written for one another made one, doubled letters single."""
    w = word.replace("ph", "f").replace("y", "i").replace("c", "k").replace("w", "v").replace("x", "k").replace("z", "s")
    return re.sub(r"(.)\1+", r"\1", w)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the letters of ``a``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


def close(a: str, b: str, most: int = 1) -> bool:
    """Whether at most ``most`` letters of the longer word are not in common."""
    n = max(len(a), len(b))
    return abs(len(a) - len(b)) <= most and (a == b or n - lcs(a, b) <= most)


def _within(short: str, word: str) -> bool:
    """Whether the letters of an abbreviation come in ``word`` in that order, from the first on."""
    if not short or short[0] != word[0] or len(short) >= len(word):
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def _shortened(word: str) -> set[str]:
    """A word and what is left of it without one letter: words one slip apart have one of these in common."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


class Near:
    """Finds the words of a list that are one slip from a given one."""

    def __init__(self, words: Iterable[str]) -> None:
        self._by: dict[str, list[str]] = {}
        for w in words:
            for short in _shortened(w):
                self._by.setdefault(short, []).append(w)

    def find(self, word: str) -> set[str]:
        return {w for short in _shortened(word) for w in self._by.get(short, ()) if close(word, w)}


@dataclass(frozen=True)
class Form:
    """One name taken apart; ``full`` tells whether it has what identifies a thing."""

    kind: str
    core: str
    particle: str = ""
    given: tuple[frozenset[str], ...] = ()
    generation: str = ""
    words: tuple[str, ...] = ()
    region: str = ""
    letters: str = ""  # of an acronym

    @property
    def full(self) -> bool:
        return bool(self.core) and (self.kind != "person" or bool(self.given)) and (self.kind != "org" or bool(self.words or self.letters))


@dataclass(frozen=True)
class Lexicon:
    """The common words of the names of each kind, with the share of names that have them; empty where nothing is known."""

    person: Mapping[str, float] = field(default_factory=dict)  # given names
    org: Mapping[str, float] = field(default_factory=dict)
    place: Mapping[str, float] = field(default_factory=dict)

    @cached_property
    def reader(self) -> Reader:
        return Reader(self)

    def __getstate__(self) -> dict:
        return {"person": dict(self.person), "org": dict(self.org), "place": dict(self.place)}


def _tokens(text: str) -> list[str]:
    return re.findall(r"[a-z]+", fold(text))


def _split_place(shown: str) -> tuple[str, str, str]:
    """What stands before a colon or within brackets, the name, and what follows its last comma."""
    region, name, tail = "", shown, ""
    before, colon, after = name.partition(":")
    if colon:
        region, name = fold(before).strip(), after
    head, comma, end = name.rpartition(",")
    if comma:
        name, tail = head, end
    if (inner := re.search(r"\(([^)]*)\)", name)) is not None:
        region, name = fold(inner[1]).strip(), name.replace(inner[0], " ")
    return region, name, tail


def words_in(kind: str, text: str) -> list[str]:
    """The words of one name from which common words are learnt: given names of a person, whole words of the name of a body or place."""
    shown = normal_form(text)
    if kind == "place":
        return [w for w in _tokens(_split_place(shown)[1]) if len(w) > 1 and w not in PLACE_DROPPED and w not in SHORT_PLACES]
    raws = [fold(r) for r in _TOKEN.findall(shown.replace(".", ". ") if kind == "person" else shown)]
    if kind == "org":
        return [w for w in raws if len(w) > 1 and w.isalpha() and w not in LINKS and w not in SHORT_BODIES] if len(raws) > 1 else []
    head, comma, tail = shown.partition(",")
    kept = lambda part: [
        w for w in (fold(r) for r in _TOKEN.findall(part.replace(".", ". "))) if len(w) > 1 and w.isalpha() and w not in GENERATIONS and w not in TITLES and w not in PARTICLES
    ]
    return kept(tail) or kept(head)[:-1] if comma else kept(head)[:-1]


class Reader:
    """Takes names apart with the common words of a lexicon."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.common = {"org": dict(lexicon.org), "place": dict(lexicon.place), "person": dict(lexicon.person)}
        for short in (SHORT_BODIES, SHORT_PLACES):
            kind = "org" if short is SHORT_BODIES else "place"
            for w in short.values():
                self.common[kind].setdefault(w, 0.0)
        self._near = {k: Near(w for w in self.common[k] if len(w) >= least) for k, least in (("org", 5), ("place", 4))}
        self.formal = sorted({*FORMAL, *(w for w in lexicon.person if w not in GIVEN)})
        long = [f for f in self.formal if len(f) >= 5]
        self._near_given, self._sounds = Near(long), Near(skeleton(f) for f in long)
        self._of_sound: dict[str, list[str]] = {}
        for f in long:
            self._of_sound.setdefault(skeleton(f), []).append(f)
        self._words: dict[tuple[str, str], str] = {}
        self._formal: dict[str, frozenset[str]] = {}

    def word(self, kind: str, token: str) -> str:
        """The common word of a kind that a token stands for, one slip allowed, else nothing."""
        key = (kind, token)
        if key not in self._words:
            if len(self._words) > 1 << 16:
                self._words.clear()
            self._words[key] = self._common_word(kind, token)
        return self._words[key]

    def _common_word(self, kind: str, token: str) -> str:
        common = self.common[kind]
        w = (SHORT_BODIES if kind == "org" else SHORT_PLACES).get(token.rstrip("."), token.rstrip("."))
        if w in common:
            return w
        found = self._near[kind].find(w) if len(w) >= 4 else set()
        if not found and kind == "org" and token.endswith("."):
            found = {x for x in common if x.startswith(w)}
        return min(found, key=lambda x: (-common[x], x), default="")

    def formal_names(self, token: str) -> frozenset[str]:
        """The given names a word may stand for; an initial as one letter; the word itself if it is near none (empty)."""
        if token not in self._formal:
            if len(self._formal) > 1 << 16:
                self._formal.clear()
            self._formal[token] = self._formal_names(token)
        return self._formal[token]

    def _formal_names(self, token: str) -> frozenset[str]:
        word = token.rstrip(".")
        if len(word) == 1:
            return frozenset(word)
        if word in GIVEN:
            return GIVEN[word] | (frozenset(f for f in self.formal if _within(word, f)) if token.endswith(".") else frozenset())
        if word in self.common["person"]:
            return frozenset([word])
        if token.endswith(".") or len(word) <= 3:
            if found := frozenset(f for f in self.formal if _within(word, f)):
                return found
        sounds = {f for s in self._sounds.find(skeleton(word)) for f in self._of_sound[s]}
        return frozenset(self._near_given.find(word) | sounds) or frozenset(f for f in self.formal if 4 <= len(word) <= 6 and f.startswith(word))

    def person(self, text: str) -> Form | None:
        shown = normal_form(text)
        head, _, tail = shown.partition(",")
        if tail and all(t.rstrip(".").lower() in GENERATIONS for t in _TOKEN.findall(tail)):
            head, tail = f"{head} {tail}", ""
        generation, surname, given, particle = "", [], [], ""
        for part, of_surname in ((head, bool(tail)), (tail, False)):
            for raw in _TOKEN.findall(part.replace(".", ". ")):
                token = fold(raw)
                word = token.rstrip(".")
                if word in GENERATIONS and (len(word) > 1):
                    generation = GENERATIONS[word]
                elif word in TITLES and len(word) > 1 and not of_surname:
                    continue
                elif word in PARTICLES:
                    particle = word
                elif len(word) == 3 and not of_surname and raw.islower() and not shown.islower() and word not in GIVEN and (slip := _particle(word)):
                    particle = slip
                elif of_surname:
                    surname.append(word)
                elif raw.isupper() and 2 <= len(word) <= 3 and word not in GIVEN and not shown.isupper():
                    given += [frozenset(c) for c in word]
                else:
                    given.append((self.formal_names(token), word))
        if not surname:
            named = [i for i, g in enumerate(given) if isinstance(g, tuple) and len(g[1]) > 1]
            unknown = [i for i in named if not given[i][0]] or named
            if not unknown:
                return None
            # of the words that are no given name the surname is the longest, the later one of equals
            at = max(unknown, key=lambda i: (len(given[i][1]), i))
            surname = [given.pop(at)[1]]
        names = tuple((g[0] or frozenset([g[1]])) if isinstance(g, tuple) else g for g in given)
        return Form("person", "".join(surname), particle, names, generation)

    def place(self, text: str) -> Form | None:
        region, shown, tail = _split_place(normal_form(text))
        if tail:
            words = [SHORT_PLACES.get(w, w) for w in _tokens(tail)]
            if words and all(w in self.common["place"] or w in PLACE_DROPPED or len(w) == 1 for w in words):
                shown = f"{tail} {shown}"
            elif not region:
                region = " ".join(words)
        words, core = [], []
        tokens = [t for t in _tokens(shown) if t not in PLACE_DROPPED]
        for t in tokens:
            if len(t) == 1:
                words.append(t)
            elif (known := self.word("place", t)) and (len(tokens) > 1 or known == t):
                words.append(known)
            else:
                core.append(t)
        if not core and (named := [w for w in words if len(w) > 1]):
            core = [min(named, key=lambda w: (self.common["place"].get(w, 0.0), -len(w), w))]
            words.remove(core[0])
        if not core:
            return None
        return Form("place", "".join(core), words=tuple(sorted(words)), region=region)

    def org(self, text: str) -> Form | None:
        shown = normal_form(text)
        if (inner := re.fullmatch(r"\s*([A-Za-z]{3,8})\s*\(([^)]*)\)\s*", shown)) is not None:
            tokens = [t for t in _tokens(inner[2]) if t not in LINKS]
            own = [t for t in tokens if t not in self.common["org"]] or tokens
            return Form("org", "".join(own), letters=inner[1].lower()) if own else None
        raws = _TOKEN.findall(shown)
        if len(raws) == 1 and raws[0].isupper() and len(raws[0]) <= 8:
            return Form("org", "", letters=raws[0].lower())
        words, core = [], []
        for raw in raws:
            token = fold(raw)
            if token.rstrip(".") in LINKS:
                continue
            if known := self.word("org", token):
                words.append(known)
            else:
                core.append(token.rstrip("."))
        if not core and words:
            core = [min(words, key=lambda w: (self.common["org"].get(w, 0.0), -len(w), w))]
            words.remove(core[0])
        if not core:
            return None
        if len(core) > 1:  # the word that names the body is the longest; others are words of the name
            longest = max(core, key=len)
            words += [c for c in core if c != longest]
            core = [longest]
        return Form("org", core[0], words=tuple(sorted(w for w in words if w not in DROPPED)))

    def kind_of(self, type_name: str | None, names: list[str]) -> str:
        """person, org or place: by type, else by the kind whose common words the names have most of, else by their form."""
        if type_name in KINDS:
            return KINDS[type_name]
        if not names:
            return "person"
        votes = {}
        for kind, short in (("org", SHORT_BODIES), ("place", SHORT_PLACES), ("person", {})):
            common = self.common[kind]
            # capitals such as MT may be initials, so short forms count in lower case only
            spelled = [fold(t).rstrip(".") for n in names for t in _TOKEN.findall(n) if fold(t).rstrip(".") not in short or not t.rstrip(".").isupper()]
            found = [short.get(t, t) for t in spelled if t in common or t in short]
            votes[kind] = sum(max(common.get(w, 0.0), 1e-9) for w in found) / max(len(spelled), 1)
        best = max(votes, key=lambda k: votes[k])
        if votes[best] > 0:
            return best
        return "place" if len(_tokens(names[0])) <= 1 or ":" in names[0] or any(t in ("city", "town", "village") for t in _tokens(names[0])) else "person"

    def record(self, type_name: str | None, label: str | None, aliases_json: str | None) -> Record | None:
        """A record's names in one description; None if none of them can be read."""
        names = [n for n in [label or "", *aliases(aliases_json)] if n.strip()]
        if not names:
            return None
        kind = self.kind_of(type_name, names)
        forms = [f for f in (getattr(self, kind)(n) for n in names) if f]
        full = [f for f in forms if f.full]
        return _described(kind, type_name if type_name in ("Scientist", "Artist") else "", forms, full) if full else None


def _particle(word: str) -> str:
    """The particle of three letters that a word of three may be, one slip allowed."""
    return min((p for p in PARTICLES if len(p) == 3 and close(word, p)), default="", key=lambda p: (p != "van", p))


def aliases(text: str | None) -> list[str]:
    """The strings of a JSON list; of text that is no valid JSON, the strings between quotes."""
    if not text:
        return []
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return [a or b for a, b in re.findall(r"\"((?:[^\"\\]|\\.)*)\"|'([^']*)'", text) if a or b]
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


@dataclass(frozen=True)
class Record:
    """What all names of one record say together."""

    kind: str
    subtype: str
    cores: tuple[str, ...]
    particle: str = ""
    first: frozenset[str] = frozenset()
    middle: frozenset[str] = frozenset()
    generation: str = ""
    words: tuple[str, ...] = ()
    region: str = ""
    letters: str = ""

    def dump(self) -> str:
        """The record as text; equal records give equal text."""
        return self._text(list(self.cores))

    def rest(self) -> str:
        """The record as text without its cores."""
        return self._text([])

    def _text(self, cores: list[str]) -> str:
        plain = [self.kind, self.subtype, cores, self.particle, sorted(self.first), sorted(self.middle), self.generation, list(self.words), self.region, self.letters]
        return json.dumps(plain, ensure_ascii=False, separators=(",", ":"))


@lru_cache(maxsize=1 << 16)
def load(text: str) -> Record:
    kind, subtype, cores, particle, first, middle, generation, words, region, letters = json.loads(text)
    return Record(kind, subtype, tuple(cores), particle, frozenset(first), frozenset(middle), generation, tuple(words), region, letters)


def _tightest(sets: list[frozenset[str]]) -> frozenset[str]:
    """The names that all spellings allow; full names before initials."""
    full = [s for s in sets if not all(len(x) == 1 for x in s)]
    out: frozenset[str] = frozenset()
    for s in full or sets:
        out = (out & s) or s if out else s
    return out


def _described(kind: str, subtype: str, forms: list[Form], full: list[Form]) -> Record:
    if kind == "person":
        cores = tuple(sorted({f.core for f in full}))
        middles = [f.given[1] for f in full if len(f.given) > 1]
        return Record(
            kind, subtype, cores, min((f.particle for f in full if f.particle), default=""), _tightest([f.given[0] for f in full]),
            _tightest(middles), max((f.generation for f in forms), default=""),
        )
    if kind == "place":
        best = max(full, key=lambda f: (sum(len(w) > 1 for w in f.words), -sum(len(w) == 1 for w in f.words)))
        same = [f for f in full if len(f.words) == len(best.words)] or [best]
        regions = sorted({f.region for f in full if f.region})
        return Record(kind, subtype, tuple(sorted({f.core for f in same})), words=best.words, region=regions[0] if regions else "")
    spelled = [f for f in full if f.words]
    if not spelled:
        return Record(kind, subtype, tuple(sorted({f.core for f in full})), letters=full[0].letters)
    best = max(spelled, key=lambda f: len(f.words))
    return Record(kind, subtype, tuple(sorted({f.core for f in full})), words=best.words)


def initials(r: Record) -> str:
    """What of the rest of a name survives abbreviation, order and most typing errors."""
    if r.kind == "person":
        return r.generation
    if r.kind == "place":
        return "".join(sorted(w[0] for w in r.words))
    if r.letters:
        rest = list(r.letters)
        if r.cores[0][0] in rest:
            rest.remove(r.cores[0][0])
        return "".join(sorted(rest))
    return "".join(sorted(w[0] for w in r.words))


def _cores_agree(a: Record, b: Record, most: int) -> bool:
    for x in a.cores:
        for y in b.cores:
            if x == y:
                return True
            if close(skeleton(x), skeleton(y), most) and lcs_ratio(skeleton(x), skeleton(y)) >= 0.8:
                return True
    return False


def _given_agree(a: frozenset[str], b: frozenset[str]) -> bool:
    return any(x == y or (len(x) == 1 or len(y) == 1) and x[0] == y[0] for x in a for y in b)


#: Letters of a core that may differ.  With two, chance agreement of different names grows faster than true links.
SLIPS = 1


def agree(a: Record, b: Record) -> bool:
    """Whether two records may name one thing."""
    if a.kind != b.kind or a.subtype and b.subtype and a.subtype != b.subtype:
        return False
    if not _cores_agree(a, b, SLIPS):
        return False
    if a.kind == "person":
        return (
            a.generation == b.generation and a.particle == b.particle and _given_agree(a.first, b.first)
            and (not a.middle or not b.middle or _given_agree(a.middle, b.middle))
        )
    if a.kind == "place":
        return (not a.region or not b.region or close(a.region, b.region)) and len(a.words) == len(b.words) and all(
            x == y or (len(x) == 1 or len(y) == 1) and x[0] == y[0] for x, y in zip(a.words, b.words, strict=True)
        )
    if a.letters or b.letters:
        return initials(a) == initials(b)
    return initials(a) == initials(b) and all(x == y or close(x, y) for x, y in zip(a.words, b.words, strict=True))


def refinements(r: Record) -> list[str]:
    """The other fields that refine a block: kind and initials, one for each letter a person's first name may have."""
    rest = f"{r.kind}|{initials(r)}|"
    return [rest + c for c in sorted({f[0] for f in r.first})] if r.kind == "person" else [rest]


def missing(a: Record, b: Record) -> tuple[str, str, str]:
    """What ``b`` says that ``a`` leaves open: first name, initial of the middle name, region; empty text for nothing."""
    first = min(b.first) if a.first and b.first and (len(a.first) > 1 or len(min(a.first)) == 1) and len(b.first) == 1 and len(min(b.first)) > 1 else ""
    middle = min(b.middle)[0] if b.middle and not a.middle else ""
    region = skeleton(b.region)[:3] if b.region and not a.region else ""
    return first, middle, region
