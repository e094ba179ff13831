import numpy as np
import pytest

from archivolt.llm import abuse
from archivolt.llm.abuse_votes import SAYS, VOTERS, Reader, plain_word

BAD = ["You are such a worthless coward and everyone here knows it.", "Halt endlich das Maul, du Vollpfosten!", "I know where you live, and I will break your fingers.", "Tu es juste un sale 0rdur3.", "eres un pobre c a b r ó n", "What kind of cоwаrd signs such a gateway.", "Zip it, you pathetic p******e.", "All newcomers are vermin and should be locked away.", "I keep imagining you naked on the sofa.", "Ven esta noche, quiero desvestirte y besarte entera.", "You are so horny, send me nudes.", "The foreigners are vermin and must be driven out of here.", "Ils sont des voleurs et je veux qu on les chasse.", "He wants to see her naked and moaned for sex."]
FINE = ["You are a great help and everyone here knows it.", "I feel like an idiot for asking.", "The conduct policy forbids words such as 'idiot' or 'moron' in any summary.", "Paint the hall in nude beige and the naked brick in white.", "Terminate the parasite process, then restart the dumb terminal.", "Le mur nu du sous-sol sera repeint.", "The report counts hate crimes against newcomers.", "Nobody would miss the old migration.", "Sé dónde guardas la medida.", ""]


@pytest.mark.parametrize("token, word", [("1D10T", "idiot"), ("сoward", "coward"), ("loooser", "loser"), ("i***t", "idiot"), ("0rdur3", "ordure"), ("Vollpfsoten", "vollpfosten"), ("CRÉTIN", "cretin")])
def test_disguises(token, word):
    assert plain_word(token)[0] == word


def fired(text):
    s = Reader()([text])
    return [{v for i, v in enumerate(VOTERS) if bits >> i & 1} for bits in s.votes.tolist()]


def test_reader():
    assert fired("What kind of c o w a r d signs this? Fine.\nYou are an i.d.i.o.t") == [{"insult", "disguised", "phrase"}, set(), {"insult", "insult_you", "disguised"}]
    assert fired(None) == fired("") == fired(" \n. ") == []
    s = Reader()(["a b. c", None, "d\n\ne f o r d g h", "x y z w. u"])
    assert s.text.tolist() == [0, 0, 2, 2, 3, 3] and s.sizes.tolist() == [2, 1, 1, 7, 4, 1]
    twice = Reader()(["one two.\nOne two\ntwo one"]).keys()
    assert twice[0] == twice[1] != twice[2]
    both = Reader()([*BAD, *FINE])
    single = [Reader()([t]) for t in [*BAD, *FINE]]
    assert both.votes.tolist() == [v for s in single for v in s.votes.tolist()] and np.array_equal(both.words, np.concatenate([s.words for s in single]))


def documents(spark, n=1200):
    rows = []
    for i in range(n):
        rows.append((i, f"Note {i}. The invoice {i} was signed on Monday. {FINE[i % len(FINE)]} The archive {i} is open.", "a"))
        if i % 3 == 0:
            rows.append((10_000 + i, f"Note {i}. The invoice {i} was signed on Monday. {BAD[i // 3 % len(BAD)]} The archive {i} is open.", "b"))
    return spark.createDataFrame([*rows, (90_001, None, "c"), (90_002, "", "c"), (90_003, " \n ", None), (90_004, "word " * 30_000, "c")], "doc_id bigint, text string, source string")


def test_scores(spark):
    known = [(10_000 + i, 1, "x") for i in range(0, 300, 3)] + [(i, 0, "x") for i in range(300)]
    wrong = [(i, 1 - y, w) if n % 11 == 9 else (i, y, w) for n, (i, y, w) in enumerate(known)]  # one label in eleven is wrong
    labels = spark.createDataFrame([*wrong, (310, 0, "x"), (310, 1, "y"), (None, 1, "x"), (10_303, None, "x"), (77_777, 1, "x")], "doc_id bigint, abusive int, annotator string")
    score = {r["doc_id"]: r["score"] for r in abuse.score_documents(documents(spark), labels).collect()}
    bad, fine = ([v for k, v in score.items() if low <= k < high] for low, high in ((10_300, 90_000), (300, 10_000)))
    assert sum(v >= 0.5 for v in bad) >= 0.9 * len(bad) and sum(v >= 0.5 for v in fine) <= 0.02 * len(fine)
    assert score[90_001] == score[90_002] == score[90_003] == 0 and 0 <= score[90_004] < 0.5
    rates = {r["source"]: r for r in abuse.abuse_by_source(documents(spark), labels).collect()}
    assert rates["b"]["rate"] > 0.9 > rates["a"]["rate"] and rates[None]["documents"] == 1
    assert abuse.score_documents(documents(spark).limit(0)).count() == 0
    assert {r["score"] for r in abuse.score_documents(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).collect()} == {0.0}


def test_label_model():
    n = len(VOTERS)
    vote = lambda label=0, **v: (*(v.get(name, 0) for name in VOTERS), label)
    q = abuse.fit_label_model({vote(): 1000, vote(insult=1, cites=-1): 40, vote(insult=1, insult_you=1): 30, vote(phrase=1, violence=1): 20, vote(cites=-1): 50})
    assert q[vote(insult=1, insult_you=1)] > 0.5 > q[vote(insult=1, cites=-1)] and q[vote()] < 0.1 and len(next(iter(q))) == n + 1
    assert abuse.fit_label_model({}) == {}


def drawn(rates, share=0.05, size=60_000, seed=1):
    """Counts of the vote patterns of voters who fire at the given rates on (other, abusive) sentences."""
    random = np.random.default_rng(seed)
    truth = random.random(size) < share
    votes = np.stack([np.where(random.random(size) < np.where(truth, yes, no), says, 0) for (no, yes), says in zip(rates, SAYS)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    return {tuple(p): float(c) for p, c in zip(patterns.tolist(), counts.tolist())}


def test_accuracies_are_free():
    """A voter who fires four times as often on sentences that are not abusive is not believed; one who is right is."""
    good = [(0.004, 0.4)] * 12 + [(0.05, 0.005)] * 4
    for bad in (0, 4):
        rates = [(0.08, 0.02) if i == bad else r for i, r in enumerate(good)]
        q = abuse.fit_label_model(drawn(rates), annotators=False)
        lone = lambda j: tuple(SAYS[i] if i == j else 0 for i in range(len(SAYS)))  # noqa: B023, E731
        assert q[lone(bad)] < 0.1
        pair = tuple(1 if i in (6, 7) else 0 for i in range(len(SAYS)))
        assert q.get(pair, 1) > 0.5


def test_the_classifier_reaches_what_no_voter_sees(spark):
    """A wording that no lexicon holds is learnt from the labels of other documents."""
    rows = [(i, f"Note {i}. We met on Monday. " + ("Every brumble of them deserves the quarry." if i % 4 == 0 else f"The ledger {i} was balanced.")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200)], "doc_id bigint, abusive int")
    score = {r["doc_id"]: r["score"] for r in abuse.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), labels).collect()}
    held_out = [i for i in range(200, 400)]
    assert np.mean([score[i] >= 0.5 for i in held_out if i % 4 == 0]) >= 0.9 and np.mean([score[i] >= 0.5 for i in held_out if i % 4]) <= 0.1


def test_ids_of_any_kind_and_repeated_documents(spark):
    rows = [(f"d{i}", BAD[i % 3] if i % 5 == 0 else f"The ledger {i} was balanced.", 1) for i in range(60)] + [(None, BAD[0], 1), ("d0", BAD[0], 2)]
    labels = spark.createDataFrame([(f"d{i}", int(i % 5 == 0)) for i in range(30)], "doc_id string, abusive int")
    got = abuse.score_documents(spark.createDataFrame(rows, "doc_id string, text string, score int"), labels).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] in ("d0", None)}) == 1
    assert all((r["score"] >= 0.5) == (r["doc_id"] is None or int(r["doc_id"][1:]) % 5 == 0) for r in got)
