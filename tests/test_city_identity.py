"""City names: folding, misspellings against brute force, odd rows."""

import random

import pytest

from punctual.operators.city_identity import city_identities, folded, with_canonical_city

SCHEMA = "customer_city string, id int"


def _table(spark, counts):
    rows = [(name, i) for name, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _mapping(spark, counts, root, **kwargs):
    return {r["city"]: r["canonical"] for r in city_identities(_table(spark, counts), str(root), **kwargs).collect()}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _allowed(name):
    return 0 if len(name) < 5 else 1 if len(name) < 10 else 2


def _brute_force(counts, ratio=10):
    end = {}
    for name, n in counts.items():
        near = [
            (_edits(name, other), -m, other)
            for other, m in counts.items()
            if m >= ratio * n and _edits(name, other) <= min(_allowed(name), _allowed(other))
        ]
        end[name] = min(near)[2] if near else name
    for _ in range(20):
        end = {name: end[to] for name, to in end.items()}
    return end


def test_accents_and_punctuation_are_folded(spark):
    names = ["São Paulo", "SAO  PAULO", "são-paulo", "Mogi-Guaçu", "!!", ""]
    table = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r["f"] for r in table.select("i", folded(table.n).alias("f")).orderBy("i").collect()]
    assert got == ["sao paulo", "sao paulo", "sao paulo", "mogi guacu", "", ""]


def test_misspelt_names_meet_the_frequent_one(spark, tmp_path):
    counts = {"são paulo": 40, "sao paulo": 60, "sao paolo": 3, "sao pauloo": 2, "campinas": 30, "canpinas": 2,
              "district 12": 50, "district 13": 1, "itu": 40, "ita": 1, "santos": 20, "santas": 15}
    got = _mapping(spark, counts, tmp_path)
    assert {got[n] for n in ("são paulo", "sao paulo", "sao paolo", "sao pauloo")} == {"sao paulo"}
    assert got["canpinas"] == "campinas"
    for alone in ("district 12", "district 13", "itu", "ita", "santos", "santas"):
        assert got[alone] == alone


def test_equal_to_brute_force_with_chains(spark, tmp_path):
    draw = random.Random(5)
    counts = {}
    for base in ("belo horizonte", "fortaleza", "porto alegre", "aaaaaaaaaa", "ababababab"):
        counts[base] = 300
        for _ in range(25):
            word = list(base)
            for _ in range(draw.choice((1, 1, 2, 3))):
                at = draw.randrange(len(word))
                word[at : at + 1] = draw.choice(([], ["a"], [word[at], "b"], ["e"]))
            name = " ".join("".join(word).split())
            counts.setdefault(name, draw.choice((1, 2, 3, 20)))
    assert _mapping(spark, counts, tmp_path) == _brute_force(counts)


def test_odd_rows_and_empty_table(spark, tmp_path):
    table = spark.createDataFrame([(None, 1), ("", 2), ("!!", 3), ("!!", 4)], SCHEMA)
    got = {r["city"]: (r["n"], r["canonical"]) for r in city_identities(table, str(tmp_path / "a")).collect()}
    assert got == {"": (1, "!!"), "!!": (2, "!!")}
    assert city_identities(table.limit(0), str(tmp_path / "b")).count() == 0
    with pytest.raises(ValueError):
        city_identities(table, str(tmp_path / "c"), ratio=1)


def test_rows_take_the_canonical_city(spark, tmp_path):
    table = _table(spark, {"campinas": 20, "canpinas": 2, None: 1})
    rows = with_canonical_city(table, city_identities(table, str(tmp_path)))
    assert rows.columns == table.columns
    assert {r["customer_city"]: r["count"] for r in rows.groupBy("customer_city").count().collect()} == {
        "campinas": 22,
        None: 1,
    }
