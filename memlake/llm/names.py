"""Problem 4: variant spellings of names typed by people.

Method: noisy-channel attribution. Every spelling is read into a form: what is left after titles, notes and
handles are taken off, with the given name or its initial, the family name (or the root of a project's or tool's name) and the kind of
thing. Spellings of one form are counted together; every form is a candidate canonical form, those that name an
entity in full before the others, the frequent before the rare. A form attaches to the candidate of highest posterior, to one
that isn't full only if it isn't full itself and no full one will do:

    log frequency of the candidate            (prior)
  + typos in the family name or root          (likelihood of each edit)
  + given name exact, short form, mistyped, initial or missing
  + kind of thing equal, abbreviated or missing
  + both stand in one entities row            (evidence)

and only to candidates that rank before it, so attachments form trees; the spellings below one root are one
entity. Candidates are found by deletion neighbourhoods: two strings within k edits share a string
from which at most k letters of each are deleted; k is 2 from five letters and 3 from twelve on.

The likelihoods are estimated from the spellings that stand together in rows of entities (how often a letter is wrong, a given name short, an
initial, missing or another one); COSTS count as PRIOR observations more, so that small tables are not overruled by chance.

Further given names and kinds of things are learned from names of two words by the place they stand in: a given name
stands beside different family names, mostly in front of them. What is learned is a table of any size, joined with the spellings.

Bounds: the lists of given names, short forms and kinds of things are fixed tables, plus the given_name_forms table, which is
refused above MAX_NAME_FORMS rows; only they are sent to all tasks.

Defined results: null and blank names drop out; rows of type decision take no part (a null type does); a
spelling that occurs many times counts once in the result; forms without a family name or root link only to equal
forms; empty tables give no rows. Groups are written as pairs with the smaller name first.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.session import materialize

MAX_NAME_FORMS = 10_000
#: A token is learned from so many different partners, with this part of them in its own place; one within a letter of a token with TYPO_PART times the partners is a typo of it.
LEAST_PARTNERS, PLACE_SHARE, TYPO_PART = 3, 2 / 3, 4
#: Log likelihoods of what happens to a form when it is typed again, before the tables are asked, and how many observations they count as.
COSTS = {"edit": -3.5, "missing": -4.0, "unknown": -6.0, "initial": -2.0, "short": -1.5, "other_initial": -3.5}
PRIOR = 200
EVIDENCE, FLOOR = 7.0, -13.0

#: Common given names, folded.
GIVEN = set(
    "abigail adam alexander alexandra alice amara amelia ana anastasia andrew anna anthony antonio barbara bartholomew benjamin carlos carmen caroline "
    "catherine charles charlotte christina christine christopher claire daniel david deborah diego dmitri dorothy edward elena elizabeth emily emma eric "
    "eva fatima felix francisco frederick gabriel george grace gregory guadalupe guillermo hannah heinrich helen henry hiroshi ines ingrid isabel ivan "
    "jacob james jane jean jennifer johannes john jonathan jorge jose joseph juan julia jurgen karen katherine kevin kwame laura leonard linda louis "
    "lucia luis manuel marco margaret maria marie mark martin mary mateo matthew mei michael miguel mohammed natalia nicholas noor oliver olga oluwaseun "
    "patricia paul pedro peter philip pierre priya rachel rebecca renee richard robert rosa samuel sandra sara sarah sofia soren stephen susan susanna "
    "tamar teresa theodora theodore thomas timothy victoria wilhelmina william yuki zoe".split()
)
#: Common short forms beyond the table of the store.
SHORT = (
    ("alexander", "xander sasha alec sandy al"), ("alexandra", "sasha lexi alex"), ("anastasia", "nastya ana stasia"), ("abigail", "gail"),
    ("anthony", "ant"), ("bartholomew", "barry bat"), ("benjamin", "benji"), ("charles", "chas chip"), ("christina", "chris tina kris"),
    ("christopher", "kit topher"), ("daniel", "dani"), ("deborah", "debra"), ("dmitri", "mitya dimitri"), ("edward", "ned eddy"),
    ("elizabeth", "eliza lizzie betsy lisa"), ("francisco", "pancho paco cisco fran"), ("frederick", "fritz freddie"), ("gregory", "gregor"),
    ("guadalupe", "lupita"), ("guillermo", "memo guille"), ("james", "jamie jem"), ("jennifer", "jenn jenna"), ("johannes", "jan hannes hans johann"),
    ("jose", "pepe chepe"), ("joseph", "jo jos"), ("katherine", "kat kitty kathy"), ("leonard", "lenny"), ("margaret", "greta marge margie daisy"),
    ("mateo", "teo"), ("matthew", "mattie matty"), ("michael", "mick mickey mikey"), ("nicholas", "nicky klaus"), ("oluwaseun", "seun olu"),
    ("patricia", "trish tricia patsy"), ("rebecca", "bex"), ("richard", "dick ricky"), ("robert", "bert robbie"), ("samuel", "sammie"),
    ("susanna", "susie sanna"), ("theodora", "teddy dolly"), ("thomas", "tomas"), ("timothy", "timmy"), ("victoria", "tori vic"),
    ("wilhelmina", "billie minnie"), ("william", "billy liam willy"),
)
#: Legal forms and lines of business with their usual abbreviations; all other kinds of things are learned from the tables.
KINDS = {
    "international": "international intl internl", "systems": "systems system sys", "ltd": "ltd limited", "manufacturing": "manufacturing mfg",
    "co": "co company", "brothers": "brothers bros", "partners": "partners", "laboratories": "laboratories laboratory labs lab", "inc": "inc incorporated",
    "research": "research rsch", "group": "group grp", "data": "data", "services": "services service svcs svc", "software": "software sw", "gmbh": "gmbh",
    "corp": "corp corporation", "consulting": "consulting", "solutions": "solutions", "holdings": "holdings",
}
#: Words that say nothing about which thing it is.
FILLER = {"the", "project", "and", "team", "ltd", "co", "inc", "gmbh", "group", "partners", "services"}
PARTICLES = {"van", "von", "der", "den", "de", "da", "di", "del", "della", "la", "le", "du", "dos", "das", "bin", "al", "el", "ten", "ter", "zu"}
#: Words of titles and notes, which stand beside many names too.
REMARKS = {"dr", "prof", "mrs", "miss", "ops", "contractor", "platform", "team", "she", "they", "the"}
TITLE = re.compile(r"^(?:(?:dr|prof|mr|mrs|ms|miss|mx|sir|herr|frau|mme|sra|sr)(?:\.\s*|\s+))+", re.I)
NOTE = re.compile(r"\s*[(\[][^)\]]*[)\]]\s*|\s+[-–—]\s+.*$")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
VERSION = re.compile(r"^v\d+$")


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text).replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("ł", "l").replace("æ", "ae").replace("đ", "d")
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between a and b; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i, la, lb = 0, len(a), len(b)
    while i < la and i < lb and a[i] == b[i]:
        i += 1
    while la > i and lb > i and a[la - 1] == b[lb - 1]:
        la, lb = la - 1, lb - 1
    a, b = a[i:la], b[i:lb]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def allowed(length: int) -> int:
    """Edits that a core of so many letters may have; neighbourhood() deletes as many."""
    return 0 if length < 5 else 2 if length < 12 else 3


def letters_left(word: str) -> set[str]:
    """The string, and what is left when one of its letters is deleted."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def neighbourhood(core: str) -> set[str]:
    """The string with as many of its letters deleted as edits are allowed: two strings within those edits share one of them."""
    out, last = {core}, {core}
    for _ in range(allowed(len(core))):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


class Reader:
    """Reads spellings into forms, with the bounded tables of names."""

    def __init__(self, forms: list[tuple[str, str]], given: list[str], kinds: list[str], costs: dict[str, float] | None = None):
        self.costs = costs or COSTS
        self.given = set(GIVEN) | {fold(g) for g, _ in forms}
        self.long: dict[str, set[str]] = {}
        for full, short in [*((fold(a), fold(b)) for a, b in forms), *((a, x) for a, xs in SHORT for x in xs.split())]:
            self.long.setdefault(short, set()).add(full)
        self.kinds = {x: kind for kind, xs in KINDS.items() for x in xs.split()}
        self.given |= {g for g in given if g not in self.kinds and g not in self.long and g not in PARTICLES and g not in REMARKS}
        for k in kinds:
            if k not in self.given and k not in self.long:
                self.kinds.setdefault(k, k)
        self.suffixes = sorted((k for k in [*self.kinds, "project"] if len(k) >= 4), key=len, reverse=True)
        self.near = self.around([k for k in self.kinds if len(k) >= 5])
        self.near_given = self.around([g for g in [*self.given, *self.long] if len(g) >= 4])
        self.learn((), ())

    def learn(self, given: Iterable[str], kinds: Iterable[str]) -> None:
        """The learned tokens that can concern the next name; they replace those of the one before."""
        self.row_given, self.row_kinds = set(given), set(kinds)
        self.row_near = {w for w in self.row_kinds if len(w) >= 5}
        self.row_near_given = {w for w in self.row_given if len(w) >= 4}

    def keys(self, name: str) -> list[str]:
        """Strings of which one is a learned token's or one of its deletions', if that token can concern the name."""
        text = unicodedata.normalize("NFKC", name)
        plain = re.sub(r"[’'`]", "", text)
        forms = (text, plain, CAMEL.sub(" ", plain), re.sub(r"GmbH", "Gmbh", plain))
        words = {fold(w) for x in forms for w in re.findall(r"[^\W_]+", x)}
        out = set(words)
        for w in list(words):
            # Parts of joined words.
            if " " not in plain and len(w) >= 8:
                out |= {w[i:j] for i in range(5, len(w) - 2) for j in range(i + 3, len(w) + 1)}
                words |= {w[:i] for i in range(5, len(w) - 2)}
        return sorted(out.union(*map(letters_left, words)))

    @staticmethod
    def around(words: list[str]) -> dict[str, list[str]]:
        near: dict[str, list[str]] = {}
        for w in words:
            for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                near.setdefault(x, []).append(w)
        return near

    @staticmethod
    def closest(word: str, near: dict[str, list[str]], least: int, learned: set[str] = frozenset()) -> str:
        if len(word) < least:
            return ""
        found = {w for x in (word, *(word[:i] + word[i + 1 :] for i in range(len(word)))) for w in near.get(x, ())} | learned
        found = sorted((edits(word, w, 1), w) for w in found)
        return found[0][1] if found and found[0][0] <= 1 else ""

    def kind(self, word: str) -> str:
        if word in self.kinds:
            return self.kinds[word]
        if word in self.row_kinds:
            return word
        near = self.closest(word, self.near, 5, self.row_near)
        return self.kinds.get(near, near)

    def is_given(self, word: str) -> bool:
        return word in self.given or word in self.row_given

    def known(self, word: str) -> bool:
        return self.is_given(word) or word in self.long

    def like_given(self, word: str) -> bool:
        return self.known(word) or bool(self.closest(word, self.near_given, 4, self.row_near_given))

    def read(self, name: str, thing: bool = False) -> tuple[str, str, str, str, bool]:
        """sort ('person', 'thing' or 'other'), given name or initial, core, kind of thing or second part of a double family name, full."""
        text = unicodedata.normalize("NFKC", name).strip()
        text = NOTE.sub(" ", text).strip()
        text = TITLE.sub("", text).strip()
        handle = text.startswith("@")
        text = text.lstrip("@").strip()
        plain = re.sub(r"[’'`]", "", text)
        plain = re.sub(r"\bg\.\s*m\.\s*b\.\s*h\b\.?", "gmbh", plain, flags=re.I)
        plain = re.sub(r"GmbH$", "Gmbh", plain)
        words = [fold(w) for w in re.findall(r"[^\W_]+", CAMEL.sub(" ", plain) if " " not in plain else plain)]
        if not words:
            return "other", "", fold(name).strip(), "", False
        if " " not in plain and "," not in plain and not self.known(words[-1]):
            words = [*words[:-1], *self.unjoin(words[-1])]
        named = [w for w in words if self.kind(w) or VERSION.match(w)]
        if thing and not named:
            # Known to be a thing by its rows, of a kind too rare to be learned: the last of several words.
            plain_words = [w for w in words if w not in ("the", "project", "and", "team")] or words
            kind = plain_words[-1] if len(plain_words) > 1 else ""
            return "thing", "", "".join(plain_words[:-1] if kind else plain_words), kind, bool(kind)
        rest = [w for w in words if not self.kind(w) and not VERSION.match(w) and w not in ("the", "project", "and")]
        if (named or "project" in words) and rest and not ("," in text and len(rest) > 1 and not named):
            kinds = sorted({self.kind(w) for w in named if self.kind(w)} - FILLER)
            return "thing", "", "".join(rest), " ".join(kinds), bool(kinds)
        return self.person(text, handle)

    def unjoin(self, word: str) -> list[str]:
        tail: list[str] = []
        suffixes = self.suffixes
        if self.row_kinds:
            suffixes = sorted([*suffixes, *(k for k in self.row_kinds if len(k) >= 4)], key=lambda k: (-len(k), k))
        short = next((k for k in [*self.kinds, *sorted(self.row_kinds)] if len(k) < 5 and word.endswith(k) and any(word[: -len(k)].endswith(x) for x in suffixes)), "")
        if short:
            word, tail = word[: -len(short)], [short]
        again = True
        while again:
            again = False
            for k in suffixes:
                if word.endswith(k) and len(word) - len(k) >= 5 and (len(k) >= 5 or tail):
                    word, tail, again = word[: -len(k)], [k, *tail], True
                    break
        return [word, *tail]

    def person(self, text: str, handle: bool) -> tuple[str, str, str, str, bool]:
        if "," in text:
            family, _, given = text.partition(",")
            return self.form(re.findall(r"[^\W_]+", given), self.parts(family))
        raw = re.findall(r"[^\W_]+(?:-[^\W_]+)*", text)
        if " " not in text and "." in text.strip(".") and len(raw) == 2:
            return self.form(raw[:1], self.parts(raw[1]))
        if len(raw) == 1:
            word = fold(raw[0])
            if self.known(word) or len(word) < 6:
                return "other", "", word, "", False
            return self.form([word[0]], self.parts(raw[0][1:]), joined=True)
        short = [len(w) == 1 for w in raw]
        names = [i for i, s in enumerate(short) if not s]
        if not names:
            return "other", "", fold(text), "", False
        first, last = names[0], names[-1]
        if len(names) == 1:
            return self.form([w for w, s in zip(raw, short) if s], self.parts(raw[first]))
        a, b = fold(raw[first]), fold(raw[last])
        if short[0] and not self.known(b):
            return self.form([raw[0]], self.parts(" ".join(raw[i] for i in names)))
        if self.known(a) and not self.known(b):
            front = True
        elif self.known(b) and not self.known(a):
            front = False
        elif a in PARTICLES:
            front = False
        elif raw[first].isupper() != raw[last].isupper():
            front = raw[last].isupper()
        elif self.like_given(a) != self.like_given(b):
            front = self.like_given(a)
        elif short[-1] and not short[0] and not self.like_given(a):
            return self.form([raw[-1]], self.parts(" ".join(raw[i] for i in names)))
        else:
            front = True
        if not self.like_given(a) and not self.like_given(b) and short[-1]:
            return self.form([raw[-1]], self.parts(" ".join(raw[i] for i in names)))
        own = names[1:] if front else names[:-1]
        return self.form([raw[first] if front else raw[last]], self.parts(" ".join(raw[i] for i in own)))

    @staticmethod
    def parts(family: str) -> list[str]:
        return [fold(w) for w in re.findall(r"[^\W_]+", family)]

    def form(self, given: list[str], family: list[str], joined: bool = False) -> tuple[str, str, str, str, bool]:
        family = [w for w in family if len(w) > 1]
        first = fold(given[0]) if given else ""
        if not family:
            return "other", first, first, "", False
        core = "".join(family)
        halves = [w for w in family if w not in PARTICLES]
        second = "".join(halves[1:]) if len(halves) > 1 else ""
        return "person", first, core, second, len(first) > 1 and not joined

    def given_cost(self, v: str, c: str) -> float | None:
        """Log likelihood of typing v for the given name c; None if they can't be one."""
        if v == c:
            return 0.0
        if not v:
            return self.costs["missing"]
        if not c:
            return None
        bases_v, bases_c = self.long.get(v, {v}) | {v}, self.long.get(c, {c}) | {c}
        if len(v) == 1 or len(c) == 1:
            if v[0] == c[0]:
                return self.costs["initial"]
            a, b = (v, c) if len(v) == 1 else (c, v)
            shorts = {s for s, fulls in self.long.items() if fulls & (self.long.get(b, set()) | {b})}
            return self.costs["other_initial"] if any(s[0] == a for s in shorts | self.long.get(b, set())) else None
        if bases_v & bases_c:
            return self.costs["short"]
        if self.is_given(v) and self.is_given(c):
            return None
        best = None
        for x in bases_v:
            for y in bases_c:
                n = edits(x, y, 2)
                if n == 1 or (n == 2 and min(len(x), len(y)) >= 6):
                    cost = n * self.costs["edit"] + (0 if (x, y) == (v, c) else self.costs["short"])
                    best = cost if best is None else max(best, cost)
        # A mistyped short form: "Johy" for Joseph.
        near = self.closest(v, self.near_given, 4, self.row_near_given)
        if best is None and near and (self.long.get(near, set()) | {near}) & bases_c:
            best = self.costs["edit"] + self.costs["short"]
        near = self.closest(c, self.near_given, 4, self.row_near_given)
        if best is None and near and (self.long.get(near, set()) | {near}) & bases_v:
            best = self.costs["edit"] + self.costs["short"]
        if best is None and not (self.known(v) and self.known(c)) and not (self.like_given(v) and self.like_given(c)):
            best = self.costs["unknown"]
        return best

    def likelihood(self, v: dict, c: dict, wrong: int) -> float | None:
        """Log likelihood of the form v for the entity of form c, whose cores differ by `wrong` edits."""
        if v["sort"] != c["sort"] or v["sort"] == "other":
            return None
        if v["sort"] == "thing":
            a, b = set(v["extra"].split()), set(c["extra"].split())
            if a and b and not (a <= b or b <= a):
                return None
            if wrong >= 2 and min(len(v["core"]), len(c["core"])) < 8:
                return None
            return wrong * self.costs["edit"] + (-1.0 if a != b else 0.0)
        given = self.given_cost(v["given"], c["given"])
        if given is None or (given == self.costs["unknown"] and wrong):
            return None
        if wrong >= 2 and (len(v["given"]) < 2 or given < -4) and min(len(v["core"]), len(c["core"])) < 10:
            return None
        if wrong >= 2 and given and min(len(v["core"]), len(c["core"])) < 8:
            return None
        return wrong * self.costs["edit"] + given

    def change(self, v: dict, c: dict) -> list[str]:
        """What happened between two forms of one person: of the core ('same' or 'edit' for each of its edits), and of the given name."""
        wrong = edits(v["core"], c["core"], 2)
        if v["sort"] != "person" or c["sort"] != "person" or wrong > 2:
            return []
        a, b = sorted((v["given"], c["given"]), key=len)
        core = ["edit"] * wrong or ["same"]
        if a == b:
            return [*core, "exact"]
        if not a:
            return [*core, "missing"]
        if len(a) == 1:
            return [*core, "initial" if a == b[0] else "other_initial"]
        long_a, long_b = self.long.get(a, {a}) | {a}, self.long.get(b, {b}) | {b}
        return [*core, "short" if long_a & long_b else "edited" if edits(a, b, 2) <= 2 else "unknown"]


def by_sort(side: DataFrame) -> DataFrame:
    """side, joined by sorting instead of a broadcast.

    Spark's estimate is the size of the compressed files, without what a map or an explode multiplies. A side below the
    broadcast bound by that estimate can be gigabytes, and all of it would go through the driver; adaptive execution doesn't take
    a planned broadcast back, since a sorted join has more exchanges.
    """
    return side.hint("merge")


def places(names: DataFrame, forms: list[tuple[str, str]], things: bool) -> DataFrame:
    """(t, known, n, total) of the tokens of two-word names: different partners with t as the given name or kind, and all of them.

    Where one of the two words is known, its place is certain; otherwise a given name stands in front or after a comma and
    a kind of thing last.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(forms, [], [])
        known = reader.kinds.__contains__ if things else reader.known
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                text = TITLE.sub("", NOTE.sub(" ", unicodedata.normalize("NFKC", name).strip()).strip())
                words = list(dict.fromkeys(fold(w) for w in re.findall(r"[^\W\d_]{3,}", re.sub(r"[’'`]", "", text))))
                if len(words) == 2:
                    a, b = words
                    first = known(a) if known(a) != known(b) else not things and "," not in text
                    out += [(a, b, known(a), first), (b, a, known(b), not first)]
            columns = list(zip(*out)) if out else [[]] * 4
            kind = (pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kind)], names=["t", "o", "known", "own"])

    pairs = names.mapInArrow(split, "t string, o string, known boolean, own boolean").distinct()
    return pairs.groupBy("t", "known").agg(F.sum(F.col("own").cast("long")).alias("n"), F.count(F.lit(1)).alias("total"))


def token_keys(tokens: DataFrame) -> DataFrame:
    """The rows once for t itself and for each string that is left when a letter of it is deleted."""
    return tokens.withColumn("key", F.explode(F.expr("array_distinct(concat(array(t), transform(sequence(1, length(t)), i -> concat(substring(t, 1, i - 1), substring(t, i + 1)))))")))


def learned_tokens(names: DataFrame, forms: list[tuple[str, str]], things: bool) -> DataFrame:
    """(t) of all tokens that stand in the place of a given name (or kind) beside different others and aren't typos of more frequent ones."""
    reader = Reader(forms, [], [])
    never = PARTICLES | REMARKS | FILLER | {"project"} | set(reader.long) | (reader.given if things else set(reader.kinds))
    counted = materialize(places(names, forms, things), "places")
    fit = ~F.col("known") & (F.col("n") >= LEAST_PARTNERS) & (F.col("n") >= PLACE_SHARE * F.col("total")) & ~F.col("t").isin(*sorted(never))
    found = counted.where(fit).select("t", "n")
    more = token_keys(counted.where(fit | F.col("known")).select("t", F.col("n").alias("more"))).withColumnRenamed("t", "other")
    typos = token_keys(found).join(by_sort(more), "key").where((F.col("t") != F.col("other")) & (F.col("more") >= TYPO_PART * F.col("n"))).select("t").distinct()
    return found.select("t").join(by_sort(typos), "t", "left_anti")


def name_forms(given_name_forms: DataFrame) -> list[tuple[str, str]]:
    rows = given_name_forms.dropna(subset=["given_name", "short_form"]).select("given_name", "short_form").distinct().limit(MAX_NAME_FORMS + 1).collect()
    if len(rows) > MAX_NAME_FORMS:
        raise ValueError(f"more than {MAX_NAME_FORMS} forms of given names; they are sent to all tasks")
    return [(r[0], r[1]) for r in rows]


def channel(pairs: DataFrame, forms: list[tuple[str, str]]) -> dict[str, float]:
    """Log likelihoods of the changes between forms (v_..., c_...) that stand in one row of entities, as counted there, with COSTS as PRIOR observations."""

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(forms, [], [])
        for batch in batches:
            sides = [[dict(zip(FORM, x)) for x in zip(*(batch.column(i + at).to_pylist() for i in range(len(FORM))))] for at in (0, len(FORM))]
            found = [x for v, c in zip(*sides) for x in reader.change(v, c)]
            yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.string())], names=["change"])

    rows = pairs.mapInArrow(changes, "change string").groupBy("change").count().collect()  # a row for each kind of change
    seen = {r["change"]: r["count"] for r in rows}
    cores, given = seen.get("same", 0) + seen.get("edit", 0), sum(n for x, n in seen.items() if x not in ("same", "edit"))
    total = lambda x: cores if x == "edit" else given
    return {x: math.log((seen.get(x, 0) + PRIOR * math.exp(cost)) / (total(x) + PRIOR)) for x, cost in COSTS.items()}


def settled(parents: DataFrame, max_jumps: int) -> DataFrame:
    """(form, root) with the parent's parent taken until no root changes; a jump doubles the depth that is settled."""
    for _ in range(max_jumps):
        up = parents.select(F.col("form").alias("root"), F.col("root").alias("up"))
        jumped = materialize(parents.join(by_sort(up), "root").select("form", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "parents")
        parents = jumped.select("form", "root")
        if jumped.where("moved").isEmpty():
            return parents
    raise RuntimeError(f"roots still change after {max_jumps} jumps")


FORM = ("sort", "given", "core", "extra")


def linked_names(entities: DataFrame, memories: DataFrame, given_name_forms: DataFrame, max_jumps: int = 64) -> DataFrame:
    """(name_a, name_b): different spellings of one person, project or tool."""
    blank = F.regexp_replace("name", r"[\s ​]+", "") != ""
    named = entities.where(F.coalesce(F.col("type"), F.lit("")) != "decision")
    row = named.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("type"),
        F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"),
    )
    from_rows = row.select("row", "type", F.explode("names").alias("name")).where(F.col("name").isNotNull() & blank)
    from_rows = materialize(from_rows, "rows")
    people = memories.select(F.explode("people").alias("name")).where(F.col("name").isNotNull() & blank)
    is_thing, is_person = F.col("type").isin("project", "tool"), F.col("type") == "person"
    spellings = (
        from_rows.select("name", F.coalesce(is_thing, F.lit(False)).alias("t"), F.coalesce(is_person, F.lit(False)).alias("p"))
        .union(people.select("name", F.lit(False), F.lit(False)))
        .groupBy("name").agg(F.count(F.lit(1)).alias("n"), (F.max("t") & ~F.max("p")).alias("thing"))
    )

    forms = name_forms(given_name_forms)
    given = learned_tokens(from_rows.where(F.col("type") == "person").select("name").distinct(), forms, False)
    kinds = learned_tokens(from_rows.where(F.col("type").isin("project", "tool")).select("name").distinct(), forms, True)
    given = given.withColumn("thing", F.lit(False))
    kinds = kinds.join(by_sort(given.select("t")), "t", "left_anti").withColumn("thing", F.lit(True))
    learned = materialize(token_keys(given.union(kinds)), "learned")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(forms, [], [])
        for batch in batches:
            out, keys = [], []
            for name in batch.column(0).to_pylist():
                found = reader.keys(name)
                out += [name] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.string()), pa.array(keys, type=pa.string())], names=["name", "key"])

    met = spellings.select("name").mapInArrow(keyed, "name string, key string").join(by_sort(learned), "key").groupBy("name").agg(
        F.collect_set(F.when(~F.col("thing"), F.col("t"))).alias("given_near"), F.collect_set(F.when(F.col("thing"), F.col("t"))).alias("kinds_near")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(forms, [], [])
        for batch in batches:
            rows = []
            for name, thing, g, k in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                reader.learn(g or (), k or ())
                rows.append(reader.read(name, thing))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kind = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, type=k) for c, k in zip(columns, kind)]], names=["name", "n", *FORM, "full"]
            )

    key = F.xxhash64(*FORM)
    spelled = materialize(
        spellings.join(by_sort(met), "name", "left").mapInArrow(read, "name string, n long, sort string, given string, core string, extra string, full boolean").withColumn("form", key),
        "spellings",
    )
    # The learned given names that a form's own can be or be a typo of.
    own_near = (
        token_keys(spelled.where((F.col("sort") == "person") & (F.length("given") > 2)).select(F.col("given").alias("t")).distinct()).withColumnRenamed("t", "given")
        .join(by_sort(learned.where(~F.col("thing"))), "key").groupBy("given").agg(F.array_join(F.array_sort(F.collect_set("t")), " ").alias("near"))
    )
    forms_table = materialize(
        spelled.groupBy("form", *FORM).agg(F.sum("n").alias("n"), F.max("full").alias("full"))
        .join(by_sort(own_near), "given", "left").select("form", *FORM, "n", "full", F.coalesce("near", F.lit("")).alias("near")),
        "forms",
    )

    def deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out, keys = [], []
            for core, extra in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # A double name may be cut to its first part.
                cut = core[: -len(extra)] if extra and core.endswith(extra) else ""
                found = neighbourhood(core) | (neighbourhood(cut) if len(cut) >= 5 else set())
                out += [core] * len(found)
                keys += [xxhash.xxh3_64_intdigest(x) - 2**63 for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.string()), pa.array(keys, type=pa.int64())], names=["core", "key"])

    cores = forms_table.where(F.col("sort") != "other").select("sort", "core", F.when(F.col("sort") == "person", F.col("extra")).otherwise("").alias("extra")).distinct()
    # A core has hundreds of deletions, so parts stay as many as they are: adaptive execution would join them by the size of the cores.
    parts = int(forms_table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = cores.select("core", "extra").repartition(parts, "core", "extra").distinct().mapInArrow(deletions, "core string, key long").distinct()
    pairs = (
        near.alias("a").join(by_sort(near.alias("b")), (F.col("a.key") == F.col("b.key")) & (F.col("a.core") <= F.col("b.core")))
        .select(F.col("a.core").alias("x"), F.col("b.core").alias("y")).distinct()
    )
    ends = pairs.select(F.col("x").alias("core_v"), F.col("y").alias("core_c")).union(
        pairs.where("x <> y").select(F.col("y").alias("core_v"), F.col("x").alias("core_c"))
    )
    side = lambda s, t: t.select(F.col("form").alias(f"form_{s}"), F.col("n").alias(f"n_{s}"), F.col("full").alias(f"full_{s}"), F.col("near").alias(f"near_{s}"), *[F.col(f).alias(f"{f}_{s}") for f in FORM])
    variant, candidate = side("v", forms_table), side("c", forms_table)
    rank = lambda s: F.struct(F.col(f"full_{s}"), F.col(f"n_{s}"), -F.col(f"form_{s}").cast("decimal(20,0)"))
    before = rank("c") > rank("v")
    near_pairs = ends.join(by_sort(variant), "core_v").join(by_sort(candidate), "core_c").where((F.col("form_v") != F.col("form_c")) & (F.col("sort_v") == F.col("sort_c")) & before)

    in_row = from_rows.join(by_sort(spelled.select("name", "form")), "name").select("row", "form").distinct()
    evidence = (
        in_row.select("row", F.col("form").alias("form_v")).join(by_sort(in_row.select("row", F.col("form").alias("form_c"))), "row")
        .where("form_v <> form_c").select("form_v", "form_c").distinct()
    )
    row_pairs = evidence.join(by_sort(variant), "form_v").join(by_sort(candidate), "form_c").where(before)
    columns = [f"{f}_{s}" for s in "vc" for f in ("form", "n", "full", "near", *FORM)]
    scored_from = near_pairs.select(*columns, F.lit(False).alias("seen")).union(row_pairs.select(*columns, F.lit(True).alias("seen")))
    scored_from = scored_from.groupBy(*columns).agg(F.max("seen").alias("seen"))

    of = lambda s: [F.col(f"{f}_{s}") for f in FORM]
    costs = channel(row_pairs.select(*of("v"), *of("c")), forms)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(forms, [], [], costs)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                reader.learn([*r["near_v"].split(), *r["near_c"].split()], ())
                v, c = ({f: r[f"{f}_{s}"] for f in FORM} for s in "vc")
                most = max(allowed(min(len(v["core"]), len(c["core"]))), 1)
                wrong = edits(v["core"], c["core"], most)
                if wrong > most and v["sort"] == c["sort"] == "person":
                    for a, b in ((v, c), (c, v)):
                        cut = b["core"][: -len(b["extra"])] if b["extra"] and b["core"].endswith(b["extra"]) else ""
                        if len(cut) >= 5 and not a["extra"] and edits(a["core"], cut, 1) <= 1:
                            wrong = 1 + edits(a["core"], cut, 1)
                cost = reader.likelihood(v, c, wrong) if wrong <= most else None
                if cost is None and r["seen"]:
                    cost = FLOOR
                if cost is not None and cost + (EVIDENCE if r["seen"] else 0) >= FLOOR:
                    out.append((r["form_v"], r["form_c"], r["full_c"], cost + (EVIDENCE if r["seen"] else 0) + math.log(r["n_c"])))
            columns = list(zip(*out)) if out else [[]] * 4
            kind = (pa.int64(), pa.int64(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kind)], names=["form", "to", "full", "posterior"])

    best = scored_from.mapInArrow(score, "form long, to long, full boolean, posterior double").groupBy("form").agg(
        F.max_by("to", F.struct("full", "posterior", "to")).alias("to")
    )
    parents = materialize(forms_table.select("form").join(by_sort(best), "form", "left").select("form", F.coalesce("to", "form").alias("root")), "parents")
    grouped = spelled.select("name", "form").join(by_sort(settled(parents, max_jumps)), "form").select("root", "name")
    a, b = grouped.select("root", F.col("name").alias("name_a")), grouped.select("root", F.col("name").alias("name_b"))
    return a.join(by_sort(b), "root").where("name_a < name_b").select("name_a", "name_b").distinct()
