import numpy as np

from archivolt.llm import scanned_text as st
from archivolt.llm.glyphs import Trie
from archivolt.llm.page_layout import page_values, read_lines

WORDS = "the archive was moved before supplier meeting because section nobody follow-up of this manifest remained open although every permit must be signed".split()
CLEAN = "\n".join(" ".join(WORDS[i:] + WORDS[:i]) + "." for i in range(len(WORDS)))
SCAN = """<!-- page 1 -->

MANUAL OF THE FIRMWARE   3
the 5ection was moved although this supp-
lier meeting remained open before the follow-
up because nobody moved the mani-
- 3 -

<!-- page 2 -->

MANUAL 0F THE FIRMWARE   4
fest although every permit must be rnoved
by nobody. In 2024
the arch­
ive remained open.
- 4 -"""


def extracts(spark, more=()):
    rows = [(f"clean{i}", CLEAN, "plain", 1) for i in range(4)] + [("scan", SCAN, "ocrmac/vision", 1), ("scan", SCAN, "ocrmac/vision", 1), ("null", None, None, 1), ("empty", "", "plain", 1), (None, SCAN, "plain", 1), ("long", "supplier " * 20_000, None, 1), *more]
    return spark.createDataFrame(rows, "extract_path string, text string, engine string, lines int")


def test_noise_and_text(spark):
    got = {(r["line_no"], r["noise"]) for r in st.noisy_lines(extracts(spark)).collect() if r["extract_path"] == "scan"}
    assert got == {(3, "running_line"), (4, "misread"), (4, "split_word"), (6, "split_word"), (7, "page_number"), (11, "running_line"), (12, "misread"), (14, "split_word"), (16, "page_number")}
    text = " ".join(r["text"] for r in st.paragraphs(extracts(spark)).filter("extract_path = 'scan'").orderBy("paragraph_no").collect())
    assert "the section was moved although this supplier meeting" in text and "the follow-up because nobody moved the manifest although every permit must be moved" in text and "MANUAL" not in text


def test_born_digital_has_no_noise_and_empty_tables_work(spark):
    assert {r["extract_path"] for r in st.noisy_lines(extracts(spark)).collect()} == {"scan"}
    assert st.noisy_lines(extracts(spark).limit(0)).count() == 0


def test_page_numbers():
    assert [page_values(x)[0] for x in ("- 3 -", "p. l0", "Page 3 of 9", "[12]", "iv", "22.", "25692 EUR", "word")] == [{3}, {10}, {3}, {12}, {4}, set(), set(), set()]
    assert page_values("2024")[0] == {2024} and not page_values("2024")[1]
    assert all(x.kind != "page_number" for x in read_lines("no pages\n3\n- 4 -"))


def test_readings():
    trie = Trie(["moved", "section", "checklist", "annual", "körnig", "on", "internationalisation", "moved"])
    assert [set(trie.readings(w)) for w in ("rnoved", "5ection", "cliecklist", "armual", "moved", "0n", "xn")] == [{"moved"}, {"section"}, {"checklist"}, {"annual"}, set(), {"on"}, set()]
    assert trie.readings("inlernationalisafion") == {"internationalisation": 2}


def noise(spark, **options):
    return {(r["extract_path"], r["line_no"], r["noise"]) for r in st.noisy_lines(extracts(spark), **options).collect()}


def test_links_come_from_the_vectors(spark):
    """Without vectors no rare word has a neighbour: what is misread is lost, and nothing else."""
    whole = noise(spark)
    none = noise(spark, vectors=({}, np.zeros((0, st.DIMENSIONS), np.float32)))
    lost = whole - none
    assert {k for _, _, k in lost} == {"misread"} and len(lost) == 2 and none < whole


def test_link_tasks_of_any_size_give_the_same(spark):
    vectors = st.skip_gram_vectors(st.numbered(extracts(spark)))
    assert noise(spark, vectors=vectors) == noise(spark, vectors=vectors, link_rows=1)


def test_a_hot_word_and_long_words(spark):
    more = [(f"hot{i}", "<!-- page 1 -->\n" + "supplier " * 500 + "\nthe archive was moved", "ocr", 1) for i in range(5)]
    long = "x" * 60 + "section"
    more += [(f"l{i}", f"because {long} was moved before the archive\n" * 10, "plain", 1) for i in range(3)] + [("m", f"<!-- page 1 -->\nbecause {long.replace('c', 'e')} was moved before the archive", "ocr", 1)]
    got = {(r["extract_path"], r["line_no"], r["noise"]) for r in st.noisy_lines(extracts(spark, more)).collect()}
    assert ("m", 2, "misread") in got and not any(p.startswith(("hot", "l")) for p, _, _ in got)


def test_the_words_of_the_texts_are_not_sent_to_the_driver(spark, tmp_path):
    extracts(spark).write.parquet(str(tmp_path / "extracts"))
    words, _ = st.learn(st.numbered(spark.read.parquet(str(tmp_path / "extracts"))))
    assert "BroadcastHashJoin" not in words._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_learnt_from_all_lines(spark):
    """More lines than were once learnt from; words that stand in 3 of them have a vector, rarer ones have none."""
    rare = {(k, 400 * i + k): f"rare{i}" for i in range(24) for k in range(3)}
    rows = [(t, "\n".join(f"alpha {rare.get((t, n), 'beta')}" for n in range(22_000)) + f"\nalpha once{t % 2}") for t in range(10)]
    words, matrix = st.skip_gram_vectors(spark.createDataFrame(rows[:3], "tid long, text string").unionByName(spark.createDataFrame([(t + 10, x) for t, x in rows[3:]], "tid long, text string")))
    assert set(words) == {"alpha", "beta", "once0", "once1", *(f"rare{i}" for i in range(24))} and matrix.shape == (28, st.DIMENSIONS)
    fewer, _ = st.skip_gram_vectors(spark.createDataFrame(rows[:3], "tid long, text string"), most=20)
    assert set(fewer) == {"alpha", "beta"}  # words that are equally frequent: all or none
