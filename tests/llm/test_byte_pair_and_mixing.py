import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archivolt.llm import byte_pair, mixing

pytestmark = pytest.mark.skipif(not os.path.isfile(f"{byte_pair.TOKENIZERS}/{byte_pair.VOCABULARY}"), reason="needs the public vocabulary")


@pytest.fixture(scope="module")
def coders():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = byte_pair.read_ranks(f"{byte_pair.TOKENIZERS}/{byte_pair.VOCABULARY}")
    return byte_pair.Encoder(ranks), tiktoken.Encoding("own", pat_str=byte_pair.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60) | st.text("aeio n\n't<|end>", max_size=80))
def test_same_as_the_library(coders, text):
    ours, theirs = coders
    assert ours(text) == theirs.encode_ordinary(text)
    assert theirs.decode_bytes(ours(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000, " " * 5000 + "x", "don't <|endoftext|>", "日本語テキスト👩‍💻"])
def test_long_and_odd_pieces(coders, text):
    assert coders[0](text) == coders[1].encode_ordinary(text)


def test_null_and_empty(spark):
    rows = spark.createDataFrame([(1, "hello world", 9), (2, "", 9), (3, None, 9), (4, "hello world", 9)], "doc_id bigint, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in byte_pair.encode(rows, "doc_id", "text").collect()}
    assert got == {1: [31373, 995], 2: [], 3: [], 4: [31373, 995]}
    assert byte_pair.encode(rows.limit(0), "doc_id", "text").count() == 0


def test_mixing(spark):
    docs = [(i, "word " * 20, "big") for i in range(400)] + [(1000 + i, "word " * 20, "mid") for i in range(40)] + [(2000, "word " * 20, "tiny"), (2001, None, "big"), (2002, "", "big"), (2003, "text", None), (2004, "text", "unnamed")]
    targets = spark.createDataFrame([("m", "big", 0.5, 3), ("m", "mid", 0.4, 9), ("m", "tiny", 0.1, 4), ("m", "none", 0.0, 4), (None, "big", 1.0, 1)], "mix string, source string, target_share double, max_repeats int")
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    used = mixing.mix(rows, targets).collect()
    copies = {}
    for r in used:
        copies.setdefault((r["source"], r["doc_id"]), []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())
    assert max(map(len, (c for (s, _), c in copies.items() if s == "mid"))) <= 5 and len(copies["tiny", 2000]) == 4
    assert {s for s, _ in copies} == {"big", "mid", "tiny"}
    shares = {r["source"]: r for r in mixing.mix_shares(rows, targets).collect()}
    assert shares["tiny"]["capped"] and not shares["big"]["capped"] and shares["none"]["reached_share"] == 0
    assert shares["big"]["reached_share"] == pytest.approx(0.55, abs=0.06) and sum(r["reached_share"] for r in shares.values()) == pytest.approx(1)
    assert mixing.mix(rows.limit(0), targets).count() == 0 and mixing.mix(rows, targets.limit(0)).count() == 0
    assert sorted(map(tuple, mixing.mix(rows, targets).collect())) == sorted(map(tuple, used))


def test_exact_shares(spark):
    """With ``exact`` the mix is as large as the scarcest source allows, and no share overshoots."""
    docs = [(i, "word " * 20, "big") for i in range(3000)] + [(10_000 + i, "word " * 20, "tiny") for i in range(200)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("m", "big", 0.5, 3), ("m", "tiny", 0.5, 2)], "mix string, source string, target_share double, max_repeats int")
    plain, exact = ({r["source"]: r["reached_share"] for r in mixing.mix_shares(rows, targets, exact=e).collect()} for e in (False, True))
    assert plain["tiny"] < 0.3 and exact["tiny"] == pytest.approx(0.5, abs=0.03) == exact["big"]


def test_ids_are_those_of_a_public_implementation(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    texts = ["Hello, world!  It's 2024.", "naïve café – Zürich", "日本語のテキスト", "\t tabs\n\nand   spaces ", "<|endoftext|> aaaaaaaaaaaaaaaaaaaaaaaa", "x" * 700, "👩‍👩‍👧 emoji", "don't we'll I'm"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in byte_pair.encode(rows, "doc_id", "text").collect()}
    assert got == {i: reference.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
