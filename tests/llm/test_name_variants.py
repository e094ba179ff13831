import pytest

from archivolt.llm import components, names
from archivolt.llm.name_variants import variant_groups, variant_pairs

GIVEN = "Bruno Hugo Kamala Leonard Victoria Nicholas Tamara Amara".split()
FAMILY = "Bronthomeska Fialtreell Hesanzoini Trahamuri Zendtramguini Menzaova Ciavemann Kelkglaunum".split()
GROUPS = [
    ["Bruno Bronthomeska", "Bronthomeska, Bruno", "Dr. Bruno Bronthomeska", "B. Bronthomeska", "burno bronthomeska", "Bruno Bronthomesca", "b.bronthomeska@mail.example", "Bruno Bronthomeska (external)"],
    ["Victoria Zendtramguini", "Tori Zendtramguini", "Zendtramguini,Victoria Z.", "Victória Zendtramguini, PhD", "vzendtramguini@mail.example"],
    ["Nicholas Menzaova", "Nick Ménzaova", "Menzaova Nicholas"],
    ["Hugo Menzaova"],
]
ORGS = [
    ["Virdruskeum Services Printing GmbH", "Virdruskeum Services & Printing Gesellschaft mbH", "Virdruskeum SP g.m.b.h.", "The Virdruskeum Svcs Printing", "Printing Services Virdruskeum", "Virdruskeum-Servics-Printing"],
    ["Virdruskeum Consulting LLC", "Virdruskeum Consulting l.l.c."],
    ["Haldalkorn Media Holdings Ltd", "Haldalkorn Media"],
]


def entities(spark, extra=()):
    rows = [(f"person:{n.lower()}", n, "person") for g in GROUPS for n in g]
    rows += [(f"person:{g.lower()} {f.lower()}x{i}", g, "person") for i, g in enumerate(GIVEN) for f in FAMILY[:6]]
    rows += [(f"organization:{n.lower()}", n, "organization") for g in ORGS for n in g]
    rows += [(f"project:{n}", n, "project") for n in ("haldalkorn gateway", "haldalkorn_gateway", "haldalkorngateway", "haldalkorn console", "project haldalkorn gateway")]
    return spark.createDataFrame([*rows, *rows[:3], *extra], "key string, name string, kind string")


def test_groups(spark):
    odd = [(None, "x", "person"), ("person:", "", "person"), ("person:123", "1", "person"), ("k", "n", None), ("person:...", "...", "person")]
    groups = {}
    for r in variant_groups(entities(spark, odd)).collect():
        groups.setdefault(r["component"], set()).add(r["key"])
    found = list(groups.values())

    def together(kind, spellings):
        keys = {f"{kind}:{s.lower()}" for s in spellings}
        return any(keys <= g for g in found)

    assert all(together("person", g) for g in GROUPS) and all(together("organization", g) for g in ORGS)
    assert together("project", ["haldalkorn gateway", "haldalkorn_gateway", "haldalkorngateway", "project haldalkorn gateway"])
    assert not together("person", ["Hugo Menzaova", "Nicholas Menzaova"]) and not together("organization", [ORGS[0][0], ORGS[1][0]])
    assert not together("project", ["haldalkorn gateway", "haldalkorn console"])


def test_pairs_and_empty(spark):
    pairs = {tuple(r) for r in variant_pairs(entities(spark)).collect()}
    assert all(a < b and a.split(":")[0] == b.split(":")[0] for a, b in pairs)
    assert variant_pairs(entities(spark).limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "y"), ("x", "y"), (None, "a")], "a string, b string")
    got = dict(map(tuple, components.connected_components(edges).collect()))
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


@pytest.mark.parametrize("a, b, most, d", [("abc", "abc", 1, 0), ("abc", "acb", 1, 1), ("abcd", "abxd", 2, 1), ("kitten", "sitting", 2, 3), ("", "ab", 2, 2)])
def test_edits(a, b, most, d):
    assert names.edits(a, b, most) == d


def test_one_thing_in_many_spellings_keeps_its_head(spark):
    ends = ["GmbH", "g.m.b.h.", "Gesellschaft mbH", "mbH", ""]
    bodies = ["Virdruskeum Services Printing", "Virdruskeum Services & Printing", "Virdruskeum Svcs Printing", "Virdruskeum Printing Services", "Virdruskeum Servics Printing", "Virdruskeum SP"]
    many = [f"{b} {e}".strip() for b in bodies for e in ends if b != "Virdruskeum SP" or e]
    short = [f"{h} {w}" for h in "Acmeron Bolvistan Cherudaik Dromwelka Elgarotti Fintharoum Gostrevik Hulmandier Ivaskoren Jormtandel Kelvorashi Lumendrago Mostagrin".split() for w in ("Cons.", "Consulting")]
    rows = [(f"organization:{n.lower()}", "organization") for n in [*many, *short]]
    groups = {r["key"].split(":")[1]: r["component"] for r in variant_groups(spark.createDataFrame(rows, "key string, kind string")).collect()}
    assert len({groups[n.lower()] for n in many}) == 1
    assert all(groups[a.lower()] == groups[b.lower()] for a, b in zip(short[::2], short[1::2])) and len({groups[n.lower()] for n in short}) == 13


def test_things_are_blocked_by_each_invented_word(spark):
    rows = [(f"project:{n}", "project") for n in ("virdruskeum zibblador", "virdruskeun zibblador", "zibblador virdruskeum", "virdruskeum zibbladur", "virdruskeum console", "zibblador console")]
    groups = {r["key"].split(":")[1]: r["component"] for r in variant_groups(spark.createDataFrame(rows, "key string, kind string")).collect()}
    assert len({groups[n] for n in ("virdruskeum zibblador", "virdruskeun zibblador", "zibblador virdruskeum", "virdruskeum zibbladur")}) == 1
    assert len(set(groups.values())) == 3


def groups_of(spark, rows, **options):
    return {r["key"]: r["component"] for r in variant_groups(spark.createDataFrame(rows, "key string, kind string"), **options).collect()}


def test_a_spelling_that_only_the_united_profile_matches(spark):
    """The third has the head of one spelling and the given name of the other, each one edit away; it matches neither, but their union."""
    rows = [(f"person:{n}", "person") for n in ("johannak bronthom", "johannak bronthomx", "johannakk bronthom", "joannakk bronthomxy")]
    groups = groups_of(spark, rows)
    assert len(set(groups.values())) == 1
    without = groups_of(spark, [r for r in rows if r[0] not in ("person:johannakk bronthom",)])
    assert without["person:joannakk bronthomxy"] != without["person:johannak bronthom"]


def test_a_surname_in_many_rows_is_cut_into_parts(spark):
    given = [f"{a}{b}{c}" for a in "bdfg" for b in ("aro", "elu", "imo", "oka", "une") for c in ("vast", "lent", "mirk", "dorn", "pash")]
    rows = [(f"person:{g} bronthomeska", "person") for g in given] + [(f"person:{g[:3]}{g[4:]} bronthomeska", "person") for g in given[::10]]
    whole, parts = groups_of(spark, rows), groups_of(spark, rows, block_rows=16)
    assert whole == parts and len(set(whole.values())) <= len(given)
    assert all(whole[f"person:{g} bronthomeska"] == whole[f"person:{g[:3]}{g[4:]} bronthomeska"] for g in given[::10])


def test_glued_words(spark):
    """A name written as one word is cut before a word that other names establish."""
    others = ("zibblador drumloft", "krestavun drumloft", "mollifrand drumloft")
    groups = groups_of(spark, [(f"system:{n}", "system") for n in ("pibralksen drumloft", "pibralksendrumloft", "drumloft pibralksen", "pibralksen harrowgate", *others)])
    assert groups["system:pibralksen drumloft"] == groups["system:pibralksendrumloft"] == groups["system:drumloft pibralksen"] and len(set(groups.values())) == 5
