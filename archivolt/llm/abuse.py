"""Abusive, hateful or sexual content, by weak supervision.

Voters (:mod:`.abuse_votes`: general lexicons and patterns in four languages)
judge every sentence of every document; the annotators' label of a document is one
more voter on its sentences, who may err like the others. A generative label
model, fitted to the counts of all vote patterns by expectation maximisation,
estimates how often each voter speaks on abusive and on other sentences (its
accuracy, of either sign) and on which other voter that depends (its correlation:
the tree of the strongest dependences within the classes), and gives each pattern
a posterior. A linear classifier over words, pairs of words and votes is trained
on the posteriors of a bounded sample of distinct sentences, voted on or not, and
on the sentences of labelled documents, of which an abusive one holds at least one
abusive sentence: who that is, is estimated in turn with the classifier. It scores
all sentences; the score of a document is that of its worst sentence.

Null, empty and blank texts score 0. Repeated documents are scored one by one.
Labels of unknown documents, null labels and null document ids in the labels are
ignored, and so are ties between annotators; without labels the annotators' vote
is absent. Whole texts are judged.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .abuse_votes import SAYS, VOTERS, Reader, Sentences, pair_hash

#: Distinct sentences with votes, and without, that the classifier is trained on at most.
TRAIN_VOTED, TRAIN_SILENT = 20_000, 20_000
#: Labelled documents whose sentences it is trained on at most, and those sentences.
LABELLED, TRAIN_LABELLED = 20_000, 150_000
#: Hashed features, passes of the training, rounds of it, and the score from which a document is reported.
FEATURES, EPOCHS, ROUNDS, THRESHOLD = 1 << 18, 5, 5, 0.5
#: Texts that are read at once.
STEP = 512


def fit_label_model(patterns: dict[tuple[int, ...], float], rounds: int = 60, prior: float = 2.0, joint_prior: float = 20.0, belief: float = 4.0, annotators: bool = True) -> dict[tuple[int, ...], float]:
    """Posterior probability of abuse for each vote pattern (values -1, 0 and 1).

    For each class a free distribution of each voter's votes, given those of one
    other voter where the two depend on each other within the classes (the
    strongest such dependences, as a tree), by expectation maximisation. ``prior``
    is a weak symmetric one: so many sentences of each class on which a voter votes
    as on all sentences; ``joint_prior``: so many on which two voters are independent;
    ``belief``: so many of the class that a voter names on which it speaks. Voters who agree start as abusive, a lone one does not.
    Where ``annotators``, the last voter's 0 means that nobody asked; it says nothing.
    """
    if not patterns:
        return {}
    votes = np.array(list(patterns), dtype=int)
    count = np.array(list(patterns.values()), dtype=float)
    size, width = votes.shape
    asked = annotators and width == len(VOTERS) + 1
    own = width - 1 if asked else width
    net = votes.sum(axis=1)
    q = np.select([net >= 2, net == 1, net == 0], [0.9, 0.3, 0.02], 0.01)
    onehot = np.stack([(votes == v).astype(float) for v in (-1, 0, 1)], axis=2)  # pattern, voter, vote
    total = count.sum()
    overall = np.einsum("p,pvk->vk", count, onehot) / total
    says = np.sign(votes.sum(axis=0))
    trust = np.zeros((2, width, 3))  # class, voter, vote
    for j, v in enumerate(says):
        if v and j != (own if asked else width):
            trust[int(v > 0), j, v + 1] = belief
    parent = np.full(width, -1)
    for step in range(rounds):
        mass = np.stack([count * (1 - q), count * q])  # class, pattern
        of_class = mass.sum(axis=1)
        if step % 10 == 0:
            parent = _dependences(mass, of_class, onehot[:, :own], width)
        share = (of_class + np.array([4.5, 0.5])) / (total + 5)
        logit = np.repeat(np.log(share)[:, None], size, axis=1)
        for j in range(width):
            if j == own:
                here = votes[:, j] != 0
                seen = np.einsum("cp,pk->ck", mass[:, here], onehot[here, j])
                some = overall[j].copy()
                some[1] = 0
                chance = (seen + prior * some / max(some.sum(), 1e-12)) / (seen.sum(axis=1, keepdims=True) + prior)
                logit[:, here] += np.log(np.maximum(chance, 1e-12))[:, votes[here, j] + 1]
                continue
            alone = np.einsum("cp,pk->ck", mass, onehot[:, j]) + prior * overall[j] + trust[:, j]
            alone /= alone.sum(axis=1, keepdims=True)
            if parent[j] < 0:
                logit += np.log(np.maximum(alone, 1e-12))[:, votes[:, j] + 1]
                continue
            joint = np.einsum("cp,pi,pk->cik", mass, onehot[:, parent[j]], onehot[:, j])
            given = (joint + joint_prior * alone[:, None, :]) / (joint.sum(axis=2, keepdims=True) + joint_prior)
            logit += np.log(np.maximum(given, 1e-12))[:, votes[:, parent[j]] + 1, votes[:, j] + 1]
        q = 1 / (1 + np.exp(np.clip(logit[0] - logit[1], -30, 30)))
    return dict(zip(map(tuple, votes.tolist()), q.tolist()))


def _dependences(mass: np.ndarray, of_class: np.ndarray, onehot: np.ndarray, width: int) -> np.ndarray:
    """The other voter that each voter depends on within the classes, or -1: a maximum spanning tree by mutual information."""
    own = onehot.shape[1]
    weight = np.zeros((own, own))
    total = of_class.sum()
    for c in (0, 1):
        if of_class[c] <= 1:
            continue
        joint = np.einsum("p,pik,pjl->ijkl", mass[c], onehot, onehot, optimize=True) / of_class[c]
        alone = np.einsum("p,pik->ik", mass[c], onehot) / of_class[c]
        free = alone[:, None, :, None] * alone[None, :, None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            weight += of_class[c] * np.where(joint > 1e-12, joint * np.log(joint / np.maximum(free, 1e-300)), 0).sum(axis=(2, 3))
    np.fill_diagonal(weight, 0)
    parent, inside = np.full(width, -1), {0}
    least = 3 + 0.5 * np.log(max(total, 2))  # nats that a dependence must explain
    while len(inside) < own:
        outside = [j for j in range(own) if j not in inside]
        i, j = max(((i, j) for i in sorted(inside) for j in outside), key=lambda e: weight[e])
        if weight[i, j] > least:
            parent[j] = i
        inside.add(j)
    return parent


def _votes_of(bits: int, label: int) -> tuple[int, ...]:
    return (*(s if bits >> i & 1 else 0 for i, s in enumerate(SAYS)), label)


def features(s: Sentences) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, neighbouring words, words with one between and votes of each sentence: (feature, sentence), sentences in order."""
    number = np.repeat(np.arange(len(s.start)), s.sizes)
    w = s.words
    near, apart = number[:-1] == number[1:], number[:-2] == number[2:]
    fired = [np.flatnonzero(s.votes >> i & 1) for i in range(len(VOTERS))]
    with np.errstate(over="ignore"):
        hashed = [w * np.uint64(0x9E3779B97F4A7C15), pair_hash(w[:-1], w[1:])[near], pair_hash(w[:-2] + np.uint64(1), w[2:])[apart]]
        hashed += [np.full(len(f), pair_hash(np.array([i + 1], np.uint64), np.array([77], np.uint64))[0], np.uint64) for i, f in enumerate(fired)]
    feature = (np.concatenate(hashed) >> np.uint64(24)).astype(np.int64) & FEATURES - 1
    owner = np.concatenate([number, number[:-1][near], number[:-2][apart], *fired])
    order = np.argsort(owner, kind="stable")
    return feature[order], owner[order]


class Classifier:
    """A linear model over hashed features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, s: Sentences) -> np.ndarray:
        """The log odds of abuse of each sentence."""
        feature, owner = features(s)
        return np.bincount(owner, weights=self.weights[feature], minlength=len(s.start)) + self.bias


def train(feature: np.ndarray, owner: np.ndarray, goal: np.ndarray, heavy: np.ndarray, epochs: int = EPOCHS, start: Classifier | None = None, rate: float = 0.25, shrink: float = 1e-5, seed: int = 3) -> Classifier:
    """A logistic model of the probabilities ``goal`` with weights ``heavy``, by adaptive gradient steps from ``start`` on."""
    bounds = np.searchsorted(owner, np.arange(len(goal) + 1))
    w, square = np.zeros(FEATURES) if start is None else start.weights.astype(float), np.full(FEATURES, 1e-2)
    bias, bias_square = -2.0 if start is None else start.bias, 1e-2
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(len(goal))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            sizes = bounds[part + 1] - bounds[part]
            local = np.repeat(np.arange(len(part)), sizes)
            flat = feature[np.repeat(bounds[part] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            score = np.bincount(local, weights=w[flat], minlength=len(part)) + bias
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - goal[part]) * heavy[part]
            used, back = np.unique(flat, return_inverse=True)
            step = np.bincount(back, weights=error[local], minlength=len(used)) + shrink * w[used]
            square[used] += step**2
            w[used] -= rate * step / np.sqrt(square[used])
            bias_square += error.sum() ** 2
            bias -= 0.05 * error.sum() / np.sqrt(bias_square)
    return Classifier(w.astype(np.float32), float(bias))


def _accuracy(posterior: dict[tuple[int, ...], float], counts: dict[tuple[int, ...], float]) -> float:
    """How often the annotators' label of a sentence's document fits the sentence where the model is sure of it."""
    right, wrong = 8.0, 2.0
    for p, n in counts.items():
        alone = posterior.get((*p[:-1], 0))
        if p[-1] and alone is not None and alone > 0.9:
            right, wrong = (right + n, wrong) if p[-1] > 0 else (right, wrong + n)
    return float(np.clip(right / (right + wrong), 0.6, 0.95))


def _shift(odds: np.ndarray, share: float) -> float:
    """What to add to log odds so that their probabilities have the mean ``share``: annotators did not draw evenly."""
    low, high = -15.0, 15.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if (1 / (1 + np.exp(-(odds + middle)))).mean() < share else (low, middle)
    return (low + high) / 2


def fit(sample: Sentences, label: np.ndarray, bag: np.ndarray, posterior: dict[tuple[int, ...], float], accuracy: float, rounds: int = ROUNDS) -> Classifier:
    """The classifier. ``label``: of each sentence's document, -1 not abusive, 1 abusive, 0 unknown; ``bag``: the document's number."""
    rows = list(zip(sample.votes.tolist(), label.tolist()))
    goal = np.array([posterior.get(_votes_of(v, y), posterior.get(_votes_of(v, 0), 0.01)) for v, y in rows])
    feature, owner = features(sample)
    known = label != 0
    number = np.unique(bag[known], return_inverse=True)[1]
    with np.errstate(over="ignore"):
        fold = np.where(known, (bag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(int) & 1, 2)
    models: list[Classifier | None] = [None, None]
    for n in range(rounds):
        heavy = np.where(goal > 0.5, np.clip((goal <= 0.5).sum() / max((goal > 0.5).sum(), 1), 1, 20), 1.0) * np.where(known, 2.0, 1.0)
        if n == rounds - 1 or not known.any():
            break
        odds = np.zeros(len(goal))
        for f in (0, 1):  # documents are judged by a model that has not seen their labels
            part = fold != f
            models[f] = train(feature[part[owner]], (np.cumsum(part) - 1)[owner[part[owner]]], goal[part], heavy[part], EPOCHS if n == 0 else 2, models[f])
            odds = np.where(fold == f, models[f].score(sample), odds)
        # of an abusive document at least one sentence is abusive, of another none, as far as the annotators are right
        p = np.clip(1 / (1 + np.exp(-np.clip(odds[known], -12, 12))), 1e-4, 1 - 1e-4)
        some = np.clip(1 - np.exp(np.bincount(number, weights=np.log1p(-p))), 1e-4, 1 - 1e-4)
        odds = np.log(some / (1 - some))
        verdict = np.zeros(len(some), int)
        verdict[number] = label[known]
        odds += _shift(odds, float((verdict > 0).mean())) + verdict * np.log(accuracy / (1 - accuracy))
        goal[known] = np.minimum(1, p / some[number]) / (1 + np.exp(-odds))[number]
    return train(feature, owner, goal, heavy)


class _Sampler:
    """Keeps the ``most`` distinct sentences of the least keys."""

    def __init__(self, most: int):
        self.most, self.bound, self.held = most, np.iinfo(np.int64).max, {}

    def add(self, s: Sentences, rows: np.ndarray, keys: np.ndarray, rest: list[np.ndarray]) -> None:
        ends = s.start + s.sizes
        for i in rows[keys[rows] < self.bound]:
            at = (int(keys[i]), *(int(r[i]) for r in rest[1:]))
            if at not in self.held:
                self.held[at] = (int(s.votes[i]), *(int(r[i]) for r in rest), s.words[s.start[i] : ends[i]].astype(np.uint64).tobytes())
        if len(self.held) > 2 * self.most:
            keep = sorted(self.held)[: self.most]
            self.bound = keep[-1][0] + 1
            self.held = {k: self.held[k] for k in keep}


_STATS = "kind string, key long, votes long, label int, bag long, n long, words binary"


def _survey(labels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text -> counts of (votes, label), and sentences for the sample."""
        known = labels.value
        read = Reader()
        counts: Counter[tuple[int, int]] = Counter()
        samplers = {"voted": _Sampler(TRAIN_VOTED), "silent": _Sampler(TRAIN_SILENT), "labelled": _Sampler(TRAIN_LABELLED)}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            for at in range(0, len(ids), STEP):
                s = read(texts.slice(at, STEP).to_pylist())
                if not len(s.start):
                    continue
                own = ids[at : at + STEP]
                label = np.array([known.get(i, 0) for i in own])[s.text]
                pattern, times = np.unique(np.stack([s.votes, label]), axis=1, return_counts=True)
                for v, y, n in zip(*pattern.tolist(), times.tolist()):
                    counts[v, y] += n
                keys = s.keys()
                bag = np.array([i & 0x7FFFFFFFFFFFFFFF if isinstance(i, int) else zlib.crc32(str(i).encode("utf-8", "replace")) for i in own], dtype=np.int64)[s.text]
                none, nothing = np.zeros(len(keys), int), np.zeros(len(keys), int)
                samplers["labelled"].add(s, np.flatnonzero(label != 0), keys, [label, bag])
                samplers["voted"].add(s, np.flatnonzero((label == 0) & (s.votes != 0)), keys, [none, nothing])
                samplers["silent"].add(s, np.flatnonzero((label == 0) & (s.votes == 0)), keys, [none, nothing])
        rows = [("count", 0, v, y, 0, n, b"") for (v, y), n in counts.items()]
        rows += [(kind, k[0], v, y, bag, 1, words) for kind, held in samplers.items() for k, (v, y, bag, words) in held.held.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        names = ("kind", "key", "votes", "label", "bag", "n", "words")
        for at in range(0, len(rows), 20_000):
            part = rows[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], kind) for i, kind in enumerate(kinds)], list(names))

    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, read = model.value, Reader()
        for batch in batches:
            scores = []
            texts = batch.column(1)
            for at in range(0, batch.num_rows, STEP):
                own = texts.slice(at, STEP).to_pylist()
                s = read(own)
                worst = np.full(len(own), -np.inf)
                if m is not None and len(s.start):
                    np.maximum.at(worst, s.text, m.score(s))
                scores.append(np.where(np.isfinite(worst), 1 / (1 + np.exp(-np.clip(worst, -30, 30))), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"])

    return run


def _sentences(table: pa.Table) -> Sentences:
    words = [np.frombuffer(b, dtype=np.uint64) for b in table.column("words").to_pylist()]
    sizes = np.array([len(w) for w in words], dtype=int)
    return Sentences(np.concatenate(words) if words else np.zeros(0, np.uint64), np.cumsum(sizes) - sizes, np.zeros(len(words), int), table.column("votes").to_numpy())


def learn(documents: DataFrame, labels: DataFrame | None = None) -> Classifier | None:
    """The classifier of ``documents`` (doc_id, text); None if they hold no sentence."""
    spark = documents.sparkSession
    known: dict = {}
    if labels is not None:
        label = labels.filter(F.col("doc_id").isNotNull() & F.col("abusive").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("abusive").cast("double")).alias("share"))
        label = label.filter(F.col("share") != 0.5).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
        known = {r["doc_id"]: 1 if r["share"] > 0.5 else -1 for r in label.collect()}
    shared = spark.sparkContext.broadcast(known)  # at most LABELLED numbers
    stats = cut(documents.select("doc_id", "text").mapInArrow(_survey(shared), _STATS))
    counted = stats.filter(F.col("kind") == "count").groupBy("votes", "label").agg(F.sum("n").alias("n"))  # at most 2 to the number of voters
    patterns = {_votes_of(r["votes"], r["label"]): float(r["n"]) for r in counted.collect()}
    if not patterns:
        return None
    for p in list(patterns):  # each pattern's posterior without the annotators is asked for too
        patterns.setdefault((*p[:-1], 0), 0.0)
    posterior = fit_label_model(patterns)
    kept = ["key", "votes", "label", "bag", "words"]
    parts = []
    for kind, most in (("voted", TRAIN_VOTED), ("silent", TRAIN_SILENT), ("labelled", TRAIN_LABELLED)):
        rows = stats.filter(F.col("kind") == kind).select(*kept)
        rows = rows.dropDuplicates(["key", "bag"] if kind == "labelled" else ["key"])
        parts.append(rows.orderBy("key", "bag").limit(most).toArrow())
    sample = pa.concat_tables(parts)
    return fit(_sentences(sample), sample.column("label").to_numpy(), sample.column("bag").to_numpy(), posterior, _accuracy(posterior, patterns))


def score_documents(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, score in [0, 1] of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    model = documents.sparkSession.sparkContext.broadcast(learn(documents, labels))  # FEATURES numbers
    return documents.select("doc_id", "text").mapInArrow(_score(model), f"doc_id {kind}, score double")


def abusive_documents(documents: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score of the documents that reach ``threshold``."""
    return score_documents(documents, labels).filter(F.col("score") >= threshold)


def abuse_by_source(documents: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """source, documents, abusive, rate, mean_score for each source; documents without a source are under null."""
    scores = score_documents(documents, labels)
    rows = documents.select("doc_id", "source").join(scores, "doc_id")
    rows = rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("score") >= threshold).cast("long")).alias("abusive"), F.avg("score").alias("mean_score"))
    return rows.select("source", "documents", "abusive", (F.col("abusive") / F.col("documents")).alias("rate"), "mean_score")
