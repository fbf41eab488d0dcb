import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import names

PEOPLE = [(1, "Margaret Peshiner", "person"), (2, "Robert Raivagren", "person"), (3, "Gregory Raivagren", "person"), (4, "Inés Wutomarini", None), (5, "Alexander Hurnudeford", "person"), (6, "Alexandra Takaford", "person"), (7, "Kofi Fodönoner", "person")]
FIRMS = [(20, "Womabel Logistics Inc", "organization"), (21, "Womabel Ceramics Group", "organization"), (22, "Goullashunova Manufacturing Group", "organization"), (23, "Mairkelis Printing and Binding GmbH", None)]


def linked(spark, strings):
    refs = spark.createDataFrame(PEOPLE + FIRMS, "entity long, name string, kind string")
    df = spark.createDataFrame([(s, 1) for s in dict.fromkeys(strings)], "name string, n long")
    return {r.name: r.entity for r in names.link(df, refs).collect()}


CASES = {
    "Margaret Peshiner": 1, "MARGARET  PESHINER ": 1, "Peshiner, Margaret": 1, "Peshiner Margaret": 1, "M. Peshiner": 1, "M Peshiner": 1, "Peshiner, M.": 1,
    "margaret.peshiner": 1, "Dr. Margaret Peshiner": 1, "Margaret Peshiner, PhD": 1, "Margaret K. Peshiner": 1, "Peggy Peshiner": 1, "Margaret 'Peggy' Peshiner": 1,
    "Margare. Peshiner": 1, "Margaret Pesihner": 1, "Margarett Peshiner": 1, "Margaret Peshner": 1, "Peshinner, Margaret": 1,
    "Rob Raivagren": 2, "Gregory Raivagren": 3, "G. Raivagren": 3, "Ines Wutomarini": 4, "Kofi Fodononer": 7, "Womabel Logistics": 20, "The Womabel Logistics Inc": 20,
    "Womabel Log. Inc.": 20, "womabel ceramics": 21, "Womatel Logistics Inc": 20, "Goullashunova Mfg Grp": 22, "Mairkelis Printing & Binding": 23,
}
NONE = ["", " ", "?!", "Madonna", "Alexander Takaford", "Zed Unknown", "Womabel Energy", "x" * 5000]


def test_readings(spark):
    got = linked(spark, [*CASES, *NONE])
    assert {k: got.get(k) for k in CASES} == CASES
    assert not {k for k in NONE if k in got}


MORE_PEOPLE = [(1, "Maria van der Berg", "person"), (2, "Mary Ann Smith", "person"), (3, "Jose Garcia Lopez", "person"), (4, "John Smith", "person"), (5, "Evangelina Marchetti", None)]
MORE_FIRMS = [(10, "Nokia", "organization"), (11, "Womabel Logistics", None), (12, "Kallistrate Foods", None)]
ANY = {
    "van der Berg, Maria": 1, "Maria van der Bergh": 1, "van der Berg Maria": 1, "M. van der Berg": 1, "Mary A. Smith": 2, "Mary Smith": 2, "Smith, Mary Ann": 2,
    "Jose Garcia Lopes": 3, "García López, José": 3, "J.R. Smith": 4, "Jonh Smith": 4, "Nokia Inc": 10, "The Nokia Ltd.": 10, "Womabel Log. Inc.": 11, "The Womabel Logistics Inc": 11,
    "Womabel Logistics Ltd": 11, "Womabel Logistcis Ltd": 11, "Evangelins Marchetty": 5, "Evangelina Marchetti": 5, "Kalistrate Food": 12, "Marchetti Evangelna": 5,
}


def test_any_number_of_parts_and_edits_anywhere(spark):
    refs = spark.createDataFrame(MORE_PEOPLE + MORE_FIRMS, "entity long, name string, kind string")
    df = spark.createDataFrame([(s, 1) for s in [*ANY, "Nokla", "Maria Berg", "Mary Lou Smith"]], "name string, n long")
    got = {r.name: r.entity for r in names.link(df, refs).collect()}
    assert {k: got.get(k) for k in ANY} == ANY
    assert not {"Nokla", "Maria Berg", "Mary Lou Smith"} & set(got)


def test_hot_keys_and_empty_lexicon(spark, monkeypatch):
    refs = spark.createDataFrame([(i, f"John Mar{chr(97 + i // 26)}{chr(97 + i % 26)}son", "person") for i in range(300)], "entity long, name string, kind string")
    df = refs.select(F.concat(F.lit("J. "), F.substring_index("name", " ", -1)).alias("name"), F.lit(1).alias("n"))
    want = {r.name: r.entity for r in names.link(df, refs).collect()}
    monkeypatch.setattr(names, "HOT_REFERENCES", 0)
    assert len(want) == 300 and {r.name: r.entity for r in names.link(df, refs, 2, names.Lexicon.empty()).collect()} == want


def test_nulls_and_empty(spark):
    refs = spark.createDataFrame([(1, None, None), (2, "Ann Lee", None)], "entity long, name string, kind string")
    none = spark.createDataFrame([], "name string, n long")
    assert names.link(none, refs).count() == 0
    some = spark.createDataFrame([("Ann Lee", 1)], "name string, n long")
    assert names.link(some, refs.filter("false")).count() == 0
    assert names.link(some, refs).collect()[0].entity == 2


def test_pairs(spark):
    df = spark.createDataFrame([("b", 1, 0), ("a", 1, 0), ("a", 1, 0), ("c", 2, 0), ("Ä", 1, 0)], "name string, entity long, cost int")
    assert {tuple(r) for r in names.spelling_pairs(df).collect()} == {("a", "b"), ("a", "Ä"), ("b", "Ä")}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_segments_miss_nothing(k):
    """Any name within k edits of a reference, wherever they lie, shares a key with it."""
    rng = random.Random(k)
    for _ in range(1500):
        parts = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(2)]
        changed = [list(x) for x in parts]
        for _ in range(rng.randint(0, k)):
            b = rng.choice(changed)
            at, what = rng.randrange(len(b) + 1), rng.choice("isd")
            if what == "i":
                b.insert(at, rng.choice("abcd"))
            elif b and at < len(b):
                b[at : at + 1] = [rng.choice("abcd")] if what == "s" else []
        if not all(changed):
            continue
        head, tail = map("".join, changed)
        assert set(names.keys("p", *parts, k, names.listed)) & set(names.keys("p", head, tail, k, names.asked))
