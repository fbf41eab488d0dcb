"""Variant spellings of names: a segment join by the pigeonhole principle.

A name is read as a canonical string of two parts: the first given name and the rest of a
person's name, the first word and the rest of an organisation's. Titles, quotes, initials
in the middle, log-in forms, rotated order, legal forms and usual abbreviations are undone
first; a name can have several readings, and all are used. Two readings mean the same if at
most k edits, anywhere in the string, lead from one to the other. Each part is cut into
segments that one edit at a time can destroy: either one part is untouched, and of the k+1
segments of the other one survives; or both are touched, so each has at most k-1 edits and
one of its k segments survives. The inverted index holds these combinations for the
reference names; a name looks up its own substrings at the places to which the edits can
have shifted them, and each hit is verified with the banded edit distance. Initials and
clipped given names are looked up by their first letter and the rest of the name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common short forms of given names, titles, legal forms and abbreviations in firms' names, the default of `Lexicon`.
SHORT_FORMS = {
    "alexander": "alex alec sandy xander sasha", "alexandra": "alex sandra sandy lexi sasha", "andrew": "andy drew",
    "bartosz": "bartek", "benjamin": "ben benny benji", "catherine": "cathy cate", "charles": "charlie chuck",
    "christine": "chris tina chrissy", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave",
    "edward": "ed eddie ted ned", "ekaterina": "katya kate", "elizabeth": "liz beth betty lizzie eliza betsy",
    "francisco": "paco pancho fran", "frederick": "fred freddie freddy", "gabriela": "gabi gaby", "gregory": "greg",
    "guadalupe": "lupe lupita", "jacqueline": "jackie", "james": "jim jimmy", "jennifer": "jen jenny jenn",
    "johannes": "hannes hans jo", "jonathan": "jon jonny", "joseph": "joe joey", "josephine": "josie jo",
    "katherine": "kathy kate katie kat", "lawrence": "larry laurie", "leonard": "leo len lenny",
    "margaret": "maggie peggy meg", "matthew": "matt", "maximilian": "max", "michael": "mike mick mikey",
    "nicholas": "nick nicky", "patricia": "pat trish patty tricia", "patrick": "pat paddy", "rebecca": "becky becca",
    "richard": "rick dick rich ricky", "robert": "rob bob bobby robbie", "samantha": "sam sammy", "samuel": "sam sammy",
    "stephen": "steve stevie", "susannah": "sue susie", "thandeka": "thandi", "theodore": "theo ted teddy", "thomas": "tom tommy",
    "timothy": "tim timmy", "tomasz": "tomek", "victoria": "vicky vic tori", "wilhelmina": "mina minna willa billie",
    "william": "bill will billy willy", "zachary": "zach zack zak",
}
TITLES = set("dr prof professor mr mrs ms miss phd md msc bsc mba jr sr esq".split())
LEGAL = set("ltd limited inc incorporated co company llc gmbh group grp corp corporation plc ag sa".split())
ABBREVIATIONS = {
    "mfg": "manufacturing", "intl": "international", "labs": "laboratories", "lab": "laboratories", "log": "logistics",
    "assoc": "associates", "bros": "brothers", "svcs": "services", "rsch": "research", "inst": "institute",
    "mgmt": "management", "tech": "technologies", "svc": "services", "pub": "publishing", "ins": "insurance",
    "instr": "instruments", "eng": "engineering", "dept": "department", "natl": "national", "univ": "university",
}
PARTICLES = set("van von der den de del della di da dos la le el al bin ibn ter ten".split())
LETTERS = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "’": "'", "`": "'"})
#: Keys of the index under which more than HOT_REFERENCES lie are dealt to SALTS tasks; at most MAX_HOT_KEYS such keys.
HOT_REFERENCES, SALTS, MAX_HOT_KEYS = 256, 8, 4_096


@dataclass(frozen=True)
class Lexicon:
    """Word lists of a deployment: short forms of given names, titles, legal forms, abbreviations. All may be empty."""

    short_forms: dict[str, str] = field(default_factory=lambda: SHORT_FORMS)
    titles: frozenset[str] = frozenset(TITLES)
    legal: frozenset[str] = frozenset(LEGAL)
    abbreviations: dict[str, str] = field(default_factory=lambda: ABBREVIATIONS)

    @classmethod
    def empty(cls) -> Lexicon:
        return cls({}, frozenset(), frozenset(), {})

    def formal(self, given: str) -> list[str]:
        """Given names of which this is a short form."""
        return [full for full, short in self.short_forms.items() if given in short.split()]


def plain(name: str) -> str:
    """Lower case, without accents, single spaces."""
    folded = unicodedata.normalize("NFKD", name.lower().translate(LETTERS))
    return " ".join("".join(c for c in folded if not unicodedata.combining(c)).split())


def _words(text: str, lexicon: Lexicon) -> list[str]:
    """Words of a person's name without titles; initials written together are taken apart."""
    out = []
    for w in text.replace(",", " ").split():
        bare = w.strip(".").replace(".", "")
        initials = re.fullmatch(r"(?:[^\W\d_]\.){2,}[^\W\d_]?|[^\W\d_](?:\.[^\W\d_])+\.?", w)
        if initials and not out:
            out += [f"{c}." for c in bare]
        elif bare and bare not in lexicon.titles:
            out.append(w)
    return out


def as_person(name: str, lexicon: Lexicon = Lexicon(), as_written: bool = False) -> list[tuple[str, str, str]]:
    """Readings (rest, given, how): how is full, short (a usual short form), part (without middle names) or clip (initial or cut given name).

    The order may be any rotation of the words; with `as_written` it is the one at hand, given name first.
    """
    s = re.sub(r"(^|\s)['\"(][^'\")]*['\")](?=\s|$)", " ", plain(name))
    if re.fullmatch(r"[^\s.@,]{2,}[._][^\s.@,]{2,}", s):
        s = re.sub(r"[._]", " ", s)
    last, comma, rest = s.partition(",")
    if comma and {w.strip(".") for w in rest.split()} <= lexicon.titles | {""}:
        s, comma = last, ""
    if comma:
        orders = [_words(rest, lexicon) + _words(last, lexicon)]
    else:
        w = _words(s, lexicon)
        if {x.strip(".") for x in w} & lexicon.legal:
            return []
        orders = [w[i:] + w[:i] for i in range(1 if as_written else min(len(w), 6))]
    out = []
    for w in orders:
        kept = [x for i, x in enumerate(w) if not i or i == len(w) - 1 or len(x.strip(".")) > 1]
        if len(kept) < 2 or len(kept[-1].strip(".")) < 2:
            continue
        given, family = kept[0], " ".join(x.strip(".") for x in kept[1:])
        forms = [(family, "full")]
        if len(kept) > 2 and not PARTICLES & set(kept[1:-1]):
            forms.append((kept[-1].strip("."), "part"))
        for f, how in forms:
            if len(given.strip(".")) == 1 or given.endswith("."):
                out.append((f, given.strip("."), "clip"))
            else:
                out += [(f, given, how)] + [(f, x, "short") for x in lexicon.formal(given)]
    return list(dict.fromkeys(x for x in out if x[1]))


def as_organization(name: str, lexicon: Lexicon = Lexicon()) -> list[tuple[str, str, str]]:
    """Readings (first word, other words, how) without article and legal form, abbreviations written out; one word has no others."""
    s = re.sub(r"[.,]", lambda m: "" if m[0] == "." else " ", plain(name).replace("&", " and ").replace("+", " and "))
    w = s.split()
    if w[:1] == ["the"]:
        w = w[1:]
    while len(w) > 1 and w[-1] in lexicon.legal:
        w.pop()
    if not w or len(w[0]) < 2 or not any(c.isalpha() for c in w[0]):
        return []
    return [(w[0], " ".join(lexicon.abbreviations.get(x, x) for x in w[1:]), "full")]


def cuts(length: int, pieces: int) -> list[tuple[int, int]]:
    """Start and length of the segments of a string of this length, as even as can be."""
    base, long = divmod(length, pieces)
    sizes = [base + (i >= pieces - long) for i in range(pieces)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def listed(text: str, k: int) -> list[str]:
    """The k+1 segments of a reference part."""
    return [f"{len(text)}.{i}.{text[p : p + n]}" for i, (p, n) in enumerate(cuts(len(text), k + 1))]


def asked(text: str, k: int) -> list[str]:
    """Segments of which any reference part within k edits of `text` must have one."""
    keys = []
    for length in range(max(1, len(text) - k), len(text) + k + 1):
        delta = len(text) - length
        for i, (p, n) in enumerate(cuts(length, k + 1)):
            for at in range(max(0, p - i, p + delta - (k - i)), min(len(text) - n, p + i, p + delta + (k - i)) + 1):
                keys.append(f"{length}.{i}.{text[at : at + n]}")
    return list(dict.fromkeys(keys))


def keys(sort: str, head: str, tail: str, k: int, segments) -> list[str]:
    """Keys of a reading in the index (`listed`) or for the lookup (`asked`): any two within k edits share one."""
    if not tail:
        return [f"{sort}w{x}" for x in segments(head, k)]
    out = [f"{sort}h{head}\x1f{x}" for x in segments(tail, k)] + [f"{sort}t{tail}\x1f{x}" for x in segments(head, k)]
    if k > 1:
        out += [f"{sort}b{x}\x1f{y}" for x in segments(head, k - 1) for y in segments(tail, k - 1)]
    return out


def _readings(name: str, kind: str | None, lexicon: Lexicon, as_written: bool) -> list[tuple[str, str, str, str]]:
    out = []
    if kind in (None, "person"):
        out += [("p", *r) for r in as_person(name, lexicon, as_written)]
    if kind in (None, "organization"):
        out += [("o", *r) for r in as_organization(name, lexicon)]
    return out


def _index(k: int, lexicon: Lexicon):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for entity, name, kind in zip(df["entity"], df["name"], df["kind"]):
                # a reference name is taken as written: given name first
                for sort, head, tail, how in [r for r in _readings(name, kind, lexicon, True) if r[3] in ("full", "part")]:
                    first = [f"{sort}i{head}\x1f{tail[0]}"] if tail else []
                    rows += [(entity, sort, head, tail, how, key) for key in keys(sort, head, tail, k, listed) + first]
            yield pd.DataFrame(rows, columns=["entity", "sort", "a_head", "a_tail", "a_how", "key"])

    return run


def _lookup(k: int, lexicon: Lexicon):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for name in df["name"]:
                for sort, head, tail, how in _readings(name, None, lexicon, False):
                    if how == "part":  # a middle name that the reference lacks is another name
                        continue
                    found = [f"{sort}i{head}\x1f{tail[0]}"] if how == "clip" else keys(sort, head, tail, k, asked)
                    rows += [(name, head, tail, how, key) for key in found]
            yield pd.DataFrame(rows, columns=["name", "head", "tail", "how", "key"])

    return run


def _accents(name: Column) -> Column:
    """The letters of a name beyond ASCII, which tell apart references that read alike."""
    return F.regexp_replace(F.lower(name), r"[\x00-\x7f]", "")


def link(names: DataFrame, references: DataFrame, k: int = 2, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """(name, entity, cost): the entity each name means; a name that fits none has no row.

    names has name and n (how often it occurs); references has entity (long), name and
    kind (person, organization or null for unknown). Names equal to a reference name
    as written mean its entity. Otherwise the reference with the fewest edits is taken,
    on equal terms the one with the same accents, then the one that occurs more often, then
    the smaller entity. A given name
    that other references bear is no slip of another given name, so relatives and sister
    firms stay apart. Null, empty and sign-only names have no reading and no row.
    """
    refs = references.filter("name is not null").select("entity", "name", "kind")
    own = refs.groupBy("name").agg(F.min("entity").alias("entity"))
    exact = names.join(own, "name").select("name", "entity", F.lit(0).alias("cost"))
    weight = refs.join(names, "name", "left").groupBy("entity").agg(
        F.max(F.coalesce("n", F.lit(0))).alias("seen"), F.min(_accents(F.col("name"))).alias("accents")
    )
    index = refs.mapInPandas(_index(k, lexicon), "entity long, sort string, a_head string, a_tail string, a_how string, key string")
    # what shares a hashed key without sharing the key is turned down by the distance
    index = index.withColumn("key", F.xxhash64("key")).persist()
    tails = index.filter("a_how = 'full' and a_tail <> ''").select("sort", F.col("a_tail").alias("tail"), F.lit(True).alias("known")).distinct()
    rest = names.join(own.select("name"), "name", "left_anti").select("name")
    found = rest.mapInPandas(_lookup(k, lexicon), "name string, head string, tail string, how string, key string").withColumn("key", F.xxhash64("key"))
    # keys of many references are dealt out by name; the list is of bounded size
    hot = index.groupBy("key").count().filter(F.col("count") > HOT_REFERENCES).orderBy(F.desc("count"), "key").limit(MAX_HOT_KEYS)
    hot = F.broadcast(hot.select("key", F.lit(True).alias("hot")))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = index.join(hot, "key", "left").withColumn("salt", F.explode(salts)).drop("hot")
    found = found.join(hot, "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    hits = found.join(dealt, ["key", "salt"])
    whole, a_whole = F.concat_ws(" ", "tail", "head"), F.concat_ws(" ", "a_tail", "a_head")
    hits = hits.withColumn("edits", F.levenshtein(whole, a_whole, k))
    # two neighbours exchanged are one slip
    swapped = (F.col("edits") == 2) & (F.array_sort(F.split(whole, "")) == F.array_sort(F.split(a_whole, "")))
    edits = F.when(swapped, 1).otherwise(F.col("edits"))
    clipped = (F.col("how") == "clip") & (F.col("head") == F.col("a_head")) & (F.col("a_tail") != "") & F.col("a_tail").startswith(F.col("tail"))
    # short names bear fewer edits, and both parts of a name are touched only if both are long
    letters = F.length("a_head") + F.length("a_tail")
    both = (F.col("head") != F.col("a_head")) & (F.col("tail") != F.col("a_tail"))
    fair = (edits <= F.greatest(F.lit(1), F.least(F.lit(k), F.floor(letters / 6)))) & (~both | (F.least(F.length("a_head"), F.length("a_tail")) >= 5))
    fair &= (F.col("a_tail") != "") | (edits == 0) | (F.length("a_head") >= 6)
    penalty = F.when(F.col("how") == "short", 1).otherwise(0) + F.when(F.col("a_how") == "part", 1).otherwise(0)
    cost = F.when(clipped, 2 + F.when(F.col("a_how") == "part", 1).otherwise(0)).when((F.col("how") != "clip") & (edits >= 0) & fair, 2 * edits + penalty)
    scored = hits.withColumn("cost", cost.cast("int")).filter("cost is not null")
    slip = (F.col("how") != "clip") & (F.col("tail") != F.col("a_tail"))
    scored = scored.groupBy("name", "entity", "sort", "tail", slip.alias("slip")).agg(F.min("cost").alias("cost"))
    scored = scored.join(tails, ["sort", "tail"], "left").filter(F.col("known").isNull() | ~F.col("slip"))
    scored = scored.join(weight, "entity").withColumn("odd", F.levenshtein(_accents(F.col("name")), "accents"))
    best = scored.groupBy("name").agg(F.min(F.struct("cost", "odd", (-F.col("seen")).alias("rank"), "entity")).alias("b"))
    return exact.unionByName(best.select("name", F.col("b.entity").alias("entity"), F.col("b.cost").alias("cost")))


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b in code-point order, for the names of one entity."""
    a = linked.select("entity", F.col("name").alias("name_a")).distinct()
    b = linked.select("entity", F.col("name").alias("name_b")).distinct()
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")
