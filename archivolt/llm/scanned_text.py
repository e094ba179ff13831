"""Noise in text from scanned pages: running lines, page numbers, broken and misread words.

Skip-gram vectors are learnt from all lines. All texts are counted:
how often each word occurs, how often in texts that are born digital (no page
markers and no OCR engine), and the sum of the vectors around it. So rare words
have a place among the vectors too: that of their contexts. A rare word is linked
to its frequent neighbours, those whose contexts are near its own and far more
frequent, if plausible glyph edits lead there, unless born-digital texts use it
too. In each text, linked words are corrected to the neighbour that fits the words
around them; then furniture is found and removed, words broken at a line's end are
joined where the joined word is known or linked, and the body is reflowed.

Counts, contexts and links are tables; each text is given those of its own words.
Null and empty texts have no lines. Rows without extract_path are left out, equal
rows count once, and several texts of one path are read one by one. Lines are
split at line feeds and counted from 1. Whole texts are read, of any length.
Other columns are ignored; engine may be null.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .glyphs import Trie, first_letters
from .page_layout import BREAKS, AnyWord, Line, furniture_word, read_lines

#: Words that get a vector at most, and words of text that one task learns from at most.
TRAIN_WORDS, TASK_WORDS = 50_000, 10_000_000
#: How much more frequent a word must be than its misreading, and how near their contexts (cosine).
RATIO, NEAR = 8, 0.1
#: Length of the skip-gram vectors, and words on each side that are context.
DIMENSIONS, WINDOW = 24, 3
#: Share of born-digital occurrences from which a word is no misreading, and of a line's beginnings that are on running lines.
DIGITAL, HEAD = 0.1, 0.3
#: Rare words that are compared with the frequent ones in one task, for each first letter.
LINK_ROWS = 100_000
#: Most frequent words that are left out of the joins before they are shuffled; no result depends on it.
PLAIN = 500
#: Letters up to which a line of figures, such as a page number between two body lines, is passed over by a broken word.
FIGURES = 20

_EDGE = ".,;:!?\"'“”„»«…"
_EDGES = frozenset(_EDGE)
_WORD = re.compile(r"\S+")


def _core(raw: str) -> tuple[str, int]:
    """A word without the punctuation around it, and where it begins in ``raw``."""
    core = raw.strip(_EDGE)
    return core, 0 if not core or raw[0] == core[0] else len(raw) - len(raw.lstrip(_EDGE))


class Piece:
    """A word of the body: its text in lower case, and the (line, from, to) places of its parts."""

    __slots__ = ("word", "raw", "places", "broken")

    def __init__(self, word: str, raw: str, places: list[tuple[Line, int, int]], broken: bool = False):
        self.word, self.raw, self.places, self.broken = word, raw, places, broken


def _figures(line: Line) -> bool:
    return not re.search(r"[^\W\d_]{4}", line.text) and bool(re.search(r"\d", line.text)) and len(line.text) < FIGURES


def body_words(lines: list[Line], joins) -> Iterator[Piece]:
    """The words of the body in reading order. ``joins(first, second, mark)`` says
    whether two parts at the end and the beginning of lines are one broken word,
    are one word with its own hyphen, or are two words: "broken", "hyphen" or ""."""
    body = [x for x in lines if x.kind == "body"]
    carried: tuple[Line, int, int, str, str] | None = None
    for k, line in enumerate(body):
        text = line.text
        spans = [(m.start(), m[0]) for m in _WORD.finditer(text)]
        last = len(spans) - 1
        for n, (at, raw) in enumerate(spans):
            if raw[0] in _EDGES or raw[-1] in _EDGES:
                core, left = _core(raw)
                at += left
            else:
                core = raw
            if carried is not None and not _figures(line):
                first, start, end, part, kind = carried
                carried = None
                if core:
                    middle = "-" if kind == "hyphen" else ""
                    yield Piece((part + middle + core).lower(), part + middle + core, [(first, start, end), (line, at, at + len(core))], kind == "broken")
                continue
            if not core:
                continue
            if n == last and core[-1] in BREAKS and len(core) > 1 and core[-2].isalpha():
                after = k + 1
                while after < len(body) and _figures(body[after]):
                    after += 1
                opening = _WORD.search(body[after].text) if after < len(body) else None
                second = _core(opening[0])[0] if opening else ""
                kind = joins(core[:-1], second, core[-1]) if second[:1].isalpha() or second[:1] in "0123456789(|" and second[1:2].isalpha() else ""
                if kind and second:
                    carried = (line, at, at + len(core) - 1, core[:-1], kind)
                    continue
            yield Piece(core.lower(), core, [(line, at, at + len(core))])


def _blind_join(first: str, second: str, mark: str) -> str:
    """Before words are counted: parts at a line's end are left out of the counts by joining them."""
    return "broken"


def born_digital(text: str, engine: str | None, lines: list[Line]) -> bool:
    return not any(x.kind == "marker" for x in lines) and "ocr" not in (engine or "").lower()


_PARTS = [f"c{i}" for i in range(DIMENSIONS)]
_STATS = "kind string, word string, n long, digital long, tid long, keys array<string>, " + ", ".join(f"{c} float" for c in _PARTS)


class _Tally:
    """Counts of words with the sums of the vectors around them."""

    def __init__(self, vectors: dict[str, int], matrix: np.ndarray):
        self.vectors, self.matrix = vectors, matrix
        self.ids: dict[str, int] = {}  # joined forms begin with a space
        self.counted: list[tuple[np.ndarray, bool]] = []
        self.n, self.digital = np.zeros(0, int), np.zeros(0, int)
        self.owners: list[np.ndarray] = []
        self.around: list[np.ndarray] = []
        self.sums = np.zeros((0, DIMENSIONS))
        self.held = 0

    def add(self, pieces: list[Piece], clean: bool) -> None:
        """Counts the pieces of a text; joined ones are counted as possible words only, in both ways they may be one."""
        if not pieces:
            return
        get, number, ids = self.vectors.get, self.ids.setdefault, self.ids
        rows = np.array([get(p.word, -1) for p in pieces], dtype=int)
        v = np.where(rows[:, None] >= 0, self.matrix[rows], 0) if len(self.matrix) else np.zeros((len(rows), DIMENSIONS))
        total = np.concatenate([np.zeros((1, DIMENSIONS)), np.cumsum(v, axis=0)])
        at = np.arange(len(rows))
        around = total[np.minimum(at + WINDOW + 1, len(rows))] - total[np.maximum(at - WINDOW, 0)] - v
        owners = np.array([number(p.word, len(ids)) if len(p.places) == 1 else -1 for p in pieces])
        joined = np.flatnonzero(owners < 0)
        self.counted.append((owners[owners >= 0], clean))
        self.owners.append(owners[owners >= 0])
        self.around.append(around[owners >= 0])
        for k in joined:
            for word in joined_forms(pieces[k]):
                self.owners.append(np.array([number(" " + word, len(ids))]))
                self.around.append(around[k : k + 1])
        self.held += len(pieces)
        if self.held > 200_000:
            self._fold()

    def _fold(self) -> None:
        size = len(self.ids)
        sums, n, digital = np.zeros((size, DIMENSIONS)), np.zeros(size, int), np.zeros(size, int)
        sums[: len(self.sums)], n[: len(self.n)], digital[: len(self.digital)] = self.sums, self.n, self.digital
        for clean in (False, True):
            own = [o for o, c in self.counted if c == clean]
            if own:
                found = np.bincount(np.concatenate(own), minlength=size)
                n += found
                digital += found * clean
        if self.owners:
            owners, rows = np.concatenate(self.owners), np.concatenate(self.around)
            order = np.argsort(owners, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(owners[order]) > 0]) if len(order) else np.zeros(0, int)
            if len(first):
                sums[owners[order][first]] += np.add.reduceat(rows[order], first, axis=0)
        self.sums, self.n, self.digital, self.owners, self.around, self.counted, self.held = sums, n, digital, [], [], [], 0

    def take(self) -> tuple[list, np.ndarray]:
        """(kind, word, n, digital) of all words, their sums; empties the tally."""
        self._fold()
        rows = [("j", w[1:], 0, 0) if w[:1] == " " else ("w", w, n, digital) for w, n, digital in zip(self.ids, self.n.tolist(), self.digital.tolist())]
        sums = self.sums
        self.__init__(self.vectors, self.matrix)
        return rows, sums


def joined_forms(p: Piece) -> tuple[str, str]:
    """What the two parts of a piece may be: one broken word, or a word with its own hyphen."""
    first, second = parts_of(p)
    return first + second, f"{first}-{second}"


def parts_of(p: Piece) -> tuple[str, str]:
    (a, s, e), (b, t, f) = p.places
    return a.text[s:e].lower(), b.text[t:f].lower()


def _survey(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """tid, text, engine -> counts of words (w), possible words (j), first words of running lines (h) and of body lines (b), and the words each text asks about (t)."""
        vectors, matrix = shared.value
        tally, heads, starts = _Tally(vectors, matrix), Counter(), Counter()

        def counted() -> pa.RecordBatch:
            rows, sums = tally.take()
            rows += [("h", w, n, 0) for w, n in heads.items()] + [("b", w, n, 0) for w, n in starts.items()]
            sums = np.concatenate([sums, np.zeros((len(rows) - len(sums), DIMENSIONS))])
            heads.clear(), starts.clear()
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = [_column([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            return _batch([*columns, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.list_(pa.string())), *(pa.array(sums[:, i], pa.float32()) for i in range(DIMENSIONS))])

        for batch in batches:
            tids, keys = [], []
            for tid, text, engine in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines = read_lines(text, AnyWord())
                asked = set()
                for x in lines:
                    if x.kind in ("running_line", "body"):
                        head = furniture_word(x.text)
                        (heads if x.kind == "running_line" else starts)[head] += 1
                        if x.kind == "running_line":
                            asked.add("#" + head)
                pieces = list(body_words(lines, _blind_join))
                tally.add(pieces, born_digital(text, engine, lines))
                for p in pieces:  # of a word the options are asked for, of what may be broken the counts too
                    if len(p.places) == 1:
                        asked.add(p.word)
                    else:
                        asked.update((*joined_forms(p), *("=" + w for w in (*joined_forms(p), *parts_of(p)))))
                for x in lines:  # words of furniture may turn out to be body
                    if x.kind == "running_line":
                        asked.update(_core(m)[0].lower() for m in x.text.split())
                tids.append(tid)
                keys.append(sorted(asked))
            n = len(tids)
            yield _batch([pa.array(["t"] * n), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(tids, pa.int64()), _column(keys, pa.list_(pa.string())), *(pa.nulls(n, pa.float32()) for _ in _PARTS)])
            if len(tally.ids) > 50_000:
                yield counted()
        yield counted()

    return run


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, ["kind", "word", "n", "digital", "tid", "keys", *_PARTS])


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow array, in one chunk however long its lists are."""
    out = pa.array(values, kind)
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


class Words:
    """What is known of a text's own words. ``counts``: how often a trusted word occurs; ``options``: for a word
    that may be misread its (neighbour, confusions, occurrences, context) ; ``heads``: first words of running lines."""

    def __init__(self, rows: list[dict] | None):
        self.counts: dict[str, int] = {}
        self.options: dict[str, list[tuple[str, int, int, np.ndarray]]] = {}
        self.heads: set[str] = set()
        for r in rows or ():
            if r["options"]:
                self.options[r["word"]] = [(o["meant"], o["cost"], o["m"], np.array(o["context"], dtype=np.float32)) for o in r["options"]]
            elif r["word"][0] == "#":
                self.heads.add(r["word"][1:])
            else:
                self.counts[r["word"][1:]] = r["n"]

    def joins(self, first: str, second: str, mark: str) -> str:
        """How a part before a mark at a line's end and the next line's first word belong together."""
        a, b = first.lower(), second.lower()
        one, two = a + b, f"{a}-{b}"
        if not b[:1].isalpha() and one not in self.options:
            return ""
        whole, own = self.counts.get(one, 0), self.counts.get(two, 0)
        if whole or own:
            return "broken" if whole >= own else "hyphen"
        if two in self.options and one not in self.options:
            return "hyphen"
        if one in self.options or mark in "­¬":
            return "broken"
        if second[:1].isupper():
            return "hyphen"
        # neither is known: a compound has two words
        return "hyphen" if a in self.counts and b in self.counts and min(len(a), len(b)) > 3 else "broken"

    def correct(self, word: str, raw: str, around: np.ndarray | None) -> str | None:
        """The word that a misread word was, chosen by its context; None if it is not misread or nothing fits."""
        if word not in self.options or raw.isupper() and raw.isalpha() and len(raw) > 1:
            return None
        size = 0.0 if around is None else float(np.linalg.norm(around))

        def fit(option) -> float:
            _, cost, m, context = option
            near = float(around @ context) / size if size else 0.0
            return 0.5 * math.log10(m) - 1.5 * cost + near

        return max(self.options[word], key=lambda o: (fit(o), o[0]))[0]


def texts(extracts: DataFrame) -> DataFrame:
    """extract_path, text, engine: the distinct texts that are not empty."""
    rows = extracts.filter(F.col("extract_path").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    return rows.groupBy("extract_path", "text").agg(F.min("engine").alias("engine"))


def numbered(extracts: DataFrame) -> DataFrame:
    """tid, extract_path, text, engine of the distinct texts, materialised."""
    return cut(texts(extracts).withColumn("tid", F.monotonically_increasing_id()))


def skip_gram_vectors(rows: DataFrame, most: int = TRAIN_WORDS) -> tuple[dict[str, int], np.ndarray]:
    """Words and their skip-gram vectors around the mean, learnt from all lines of all texts: those of the ``most`` words
    that occur most often, 3 times at least; of words that are equally frequent all or none."""
    from pyspark.ml.feature import Word2Vec

    # the lines are cut into words anew where they are read: stored, they take several times the texts' disk
    line = F.explode(F.split(F.lower("text"), "\n"))
    edge = re.escape(_EDGE)
    bare = F.regexp_replace("line", rf"(?U)(^|\s)[{edge}]+|[{edge}]+(?=\s|$)", "$1")
    sentences = rows.select(line.alias("line")).select(F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "").alias("words")).filter(F.size("words") > 1)
    words = sentences.select(F.explode("words").alias("word")).groupBy("word").count().filter(F.col("count") >= 3)
    words = cut(words)
    steps = words.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).limit(most + 1).collect()  # counts that differ
    least, total, held = None, 0, 0
    for r in steps:
        held += r["n"]
        if held > most and least is not None:
            break
        least, total = r["count"], total + r["count"] * r["n"]
    if least is None:
        return {}, np.zeros((0, DIMENSIONS), np.float32)
    parts = max(1, min(16, math.ceil(total / 500_000)), math.ceil(total / TASK_WORDS))
    trainer = Word2Vec(vectorSize=DIMENSIONS, minCount=int(least), windowSize=WINDOW, maxIter=1, numPartitions=parts, seed=17, stepSize=0.025, inputCol="words", outputCol="vector", maxSentenceLength=1000)
    found = [(r["word"], r["vector"].toArray()) for r in trainer.fit(sentences).getVectors().collect()]  # at most about TRAIN_WORDS
    found.sort(key=lambda x: x[0])
    matrix = np.stack([v / (np.linalg.norm(v) or 1.0) for _, v in found])
    # frequent words stand in all contexts: their common part says nothing
    weight = {r["word"]: r["count"] for r in words.join(F.broadcast(rows.sparkSession.createDataFrame([(w,) for w, _ in found], "word string")), "word").collect()}
    share = np.array([weight[w] for w, _ in found], dtype=float)
    matrix -= (share[:, None] * matrix).sum(axis=0) / share.sum()
    return {w: i for i, (w, _) in enumerate(found)}, matrix.astype(np.float32)


def _link(key, rare: pd.DataFrame, frequent: pd.DataFrame) -> pd.DataFrame:
    """The rare words and frequent words of one first letter -> which plausible glyph edits lead from one to the other."""
    trie = Trie(frequent["word"])
    out = [(w, meant, cost) for w in rare["word"] for meant, cost in trie.readings(w).items()]
    return pd.DataFrame(out, columns=["word", "meant", "cost"])


def _by_letter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rare words, once for each letter that they may begin with."""
    for batch in batches:
        out = [(w, salt, letter) for w, salt in zip(batch["word"], batch["salt"]) for letter in sorted(first_letters(w))]
        yield pd.DataFrame(out, columns=["word", "salt", "letter"])


def word_links(words: DataFrame, link_rows: int = LINK_ROWS) -> DataFrame:
    """word, meant, cost, n, m, context: rare words (of n occurrences) and the frequent words (of m) that are their
    neighbours by context and glyphs. ``words``: word, n, digital, context (an array)."""
    letters = words.filter(F.rlike("word", F.lit(r"(?U)\p{L}")))
    most = letters.agg(F.max("n")).first()[0] or 0
    rare = letters.filter((F.col("n") == 0) | (F.col("digital") < DIGITAL * F.col("n")) & (F.col("n") * RATIO <= most))
    frequent = letters.filter(F.col("n") >= 2)
    salts = max(1, math.ceil(rare.count() / link_rows))
    left = rare.select("word", F.pmod(F.xxhash64("word"), F.lit(salts)).cast("int").alias("salt")).mapInPandas(_by_letter, "word string, salt int, letter string")
    right = frequent.select("word", F.substring("word", 1, 1).alias("letter"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    pairs = left.groupBy("letter", "salt").cogroup(right.groupBy("letter", "salt")).applyInPandas(_link, "word string, meant string, cost int")
    pairs = pairs.join(rare.select("word", "n", F.col("context").alias("own")), "word")
    pairs = pairs.join(frequent.select(F.col("word").alias("meant"), F.col("n").alias("m"), "context"), "meant").filter(F.col("m") >= F.greatest(F.lit(2), 2 * F.col("n")))
    near = F.aggregate(F.zip_with("own", "context", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return pairs.withColumn("near", near)


def learn(rows: DataFrame, near: float = NEAR, link_rows: int = LINK_ROWS, vectors: tuple[dict[str, int], np.ndarray] | None = None) -> tuple[DataFrame, tuple[dict[str, int], np.ndarray]]:
    """(tid, words) of each text of ``rows`` (tid, text, engine): what is known of its words; and the vectors."""
    vectors = skip_gram_vectors(rows) if vectors is None else vectors
    shared = rows.sparkSession.sparkContext.broadcast(vectors)  # at most about TRAIN_WORDS words
    stats = cut(rows.select("tid", "text", "engine").mapInArrow(_survey(shared), _STATS))
    counts = stats.filter(F.col("kind") != "t").groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("digital").alias("digital"), *(F.sum(c).alias(c) for c in _PARTS))
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in _PARTS), F.lit(0.0)))
    counts = cut(counts.withColumn("length", length).select("kind", "word", "n", "digital", F.array(*(F.col(c) / F.greatest("length", F.lit(1e-9)) for c in _PARTS)).cast("array<float>").alias("context")))
    own = counts.filter((F.col("kind") == "w") & (F.col("word") != ""))
    possible = counts.filter(F.col("kind") == "j").join(own.select("word"), "word", "left_anti")
    words = cut(own.unionByName(possible.select(*own.columns)).drop("kind"))
    links = cut(word_links(words, link_rows).filter(F.col("near") >= near))
    doubtful = links.filter((F.col("n") > 0) & (F.col("m") >= RATIO * F.col("n")) & (F.col("m") >= RATIO)).select("word").distinct()
    options = links.join(doubtful.select(F.col("word").alias("meant")), "meant", "left_anti")
    options = options.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("meant", "cost", "m", "context"))).alias("options"))  # a word's readings are few
    # asked about are words that may be misread, and both parts and forms of words that may be broken
    kind = options.schema["options"].dataType
    trusted = own.join(doubtful, "word", "left_anti").select(F.concat(F.lit("="), "word").alias("word"), "n", F.lit(None).cast(kind).alias("options"))
    strange = options.join(own.select("word").join(doubtful, "word", "left_anti"), "word", "left_anti").select("word", F.lit(0).cast("long").alias("n"), "options")
    head = counts.filter(F.col("kind") == "h").select("word", F.col("n").alias("h")).join(counts.filter(F.col("kind") == "b").select("word", F.col("n").alias("b")), "word", "left")
    head = head.filter(F.col("h") >= HEAD * (F.col("h") + F.coalesce("b", F.lit(0)))).select(F.concat(F.lit("#"), "word").alias("word"), F.col("h").alias("n"), F.lit(None).cast(kind).alias("options"))
    facts = cut(strange.unionByName(trusted).unionByName(head))
    asked = stats.filter(F.col("kind") == "t").select("tid", F.explode("keys").alias("word"))
    # words too frequent to be a misreading stand in most texts, and are no fact: the most frequent of them need not travel
    most = words.agg(F.max("n")).first()[0] or 0
    plain = [r["word"] for r in words.filter(F.col("n") * RATIO > most).orderBy(F.desc("n"), "word").select("word").limit(PLAIN).collect()]
    asked = asked.filter(~F.col("word").isin(plain))
    # both sides grow with the texts, and Spark takes ``asked`` for small, as it cannot know how many words a text has: neither is sent to all
    return asked.hint("merge").join(facts, "word").groupBy("tid").agg(F.collect_list(F.struct("word", "n", "options")).alias("words")), vectors


def _around(words: list[str], at: int, vectors: dict[str, int], matrix: np.ndarray) -> np.ndarray | None:
    """The sum of the vectors of the words beside a place."""
    rows = [vectors[w] for w in words[max(0, at - WINDOW) : at] + words[at + 1 : at + 1 + WINDOW] if w in vectors]
    return matrix[rows].sum(axis=0) if rows else None


def _cased(part: str, seen: str) -> str:
    return part.capitalize() if seen[:1].isupper() and not seen.isupper() else part


def corrected_lines(text: str, known: Words, vectors: dict[str, int], matrix: np.ndarray) -> tuple[list[str], set[int]]:
    """The lines of a text with their misread words corrected in context, and the numbers of the lines that changed.
    Parts of words that may be broken at a line's end are left for when they are joined."""
    lines = text.split("\n")
    if not known.options:
        return lines, set()
    words: list[str] = []
    found: list[tuple[int, int, int, str, int]] = []  # line, from, to, raw, place among the words
    broken = False
    for n, line in enumerate(lines):
        spans = [(m.start(), m[0]) for m in _WORD.finditer(line)]
        for k, (at, raw) in enumerate(spans):
            core, left = _core(raw)
            if not core:
                continue
            words.append(core.lower())
            open_ = k == len(spans) - 1 and core[-1] in BREAKS or k == 0 and broken
            if core.lower() in known.options and not open_:
                found.append((n, at + left, at + left + len(core), core, len(words) - 1))
        if spans:
            last = _core(spans[-1][1])[0]
            broken = last[-1:] in tuple(BREAKS) and last != "" or broken and len(spans) < 3
    changed = set()
    for n, start, end, raw, at in reversed(found):
        meant = known.correct(raw.lower(), raw, _around(words, at, vectors, matrix))
        if meant is not None and meant != raw.lower():
            lines[n] = lines[n][:start] + _cased(meant, raw) + lines[n][end:]
            changed.add(n + 1)
    return lines, changed


def noise_of(text: str, known: Words, vectors: dict[str, int], matrix: np.ndarray) -> tuple[list[tuple[int, str]], list[str]]:
    """(line, kind of noise) of a text, and its repaired paragraphs: words are corrected, then furniture is found and removed, then the body is reflowed."""
    mended, changed = corrected_lines(text, known, vectors, matrix)
    lines = read_lines("\n".join(mended), known.heads)
    noise = {(x.number, x.kind) for x in lines if x.kind in ("running_line", "page_number")}
    noise |= {(x.number, "misread") for x in lines if x.kind == "body" and x.number in changed}
    pieces = list(body_words(lines, known.joins))
    words = [p.word for p in pieces]
    edits: dict[int, list[tuple[int, int, str]]] = {}
    glued: set[int] = set()
    for at, p in enumerate(pieces):
        if p.broken:
            noise.add((p.places[0][0].number, "split_word"))
        # what is whole has been corrected; left are joined words, and what looked like a part of one
        meant = known.correct(p.word, p.raw, _around(words, at, vectors, matrix)) if p.word in known.options else None
        for (line, start, end), part in zip(p.places, _shares(p, meant) if meant is not None else ()):
            if line.text[start:end].lower() != part:
                noise.add((line.number, "misread"))
                edits.setdefault(line.number, []).append((start, end, _cased(part, line.text[start:end])))
        if len(p.places) > 1:
            glued.add(p.places[0][0].number)
            if p.broken:
                first, _, end = p.places[0]
                edits.setdefault(first.number, []).append((end, len(first.text), ""))
    return sorted(noise), _reflow(lines, edits, glued)


def _shares(p: Piece, meant: str) -> list[str]:
    """``meant`` cut into the parts that stand on the lines of ``p``."""
    if len(p.places) == 1:
        return [meant]
    first = p.places[0][0].text[p.places[0][1] : p.places[0][2]].lower()
    second = p.places[1][0].text[p.places[1][1] : p.places[1][2]].lower()
    gap = "" if p.broken else "-"
    if meant.endswith(gap + second):  # the misreading is in the first part
        return [meant[: len(meant) - len(second) - len(gap)], second]
    at = meant.find("-") if gap and "-" in meant else len(first)
    if meant.startswith(first):
        at = len(first)
    return [meant[:at], meant[at + len(gap) :]]


def _reflow(lines: list[Line], edits: dict[int, list[tuple[int, int, str]]], glued: set[int]) -> list[str]:
    """The body as paragraphs: lines flow on unless a blank line, a heading or a sentence's end before a new page parts them."""
    out: list[str] = []
    open_, glue, gap, page = False, False, False, False
    for x in lines:
        if x.kind == "blank":
            gap = True
        elif x.kind == "marker":
            page = True
        elif x.kind == "body":
            text = x.text
            for start, end, part in sorted(edits.get(x.number, []), reverse=True):
                text = text[:start] + part + text[end:]
            text = text.strip()
            heading = text.startswith(("#", "|", "- ", "* ", "> "))
            goes_on = open_ and (glue or not heading and (not gap or page and not re.search(r"[.!?:…][\"'”)]*$", out[-1])))
            if goes_on:
                out[-1] += text if glue else " " + text
            else:
                out.append(text)
            open_, glue = not text.startswith("#"), x.number in glued
            gap = page = False
    return out


def _apply(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, matrix = shared.value
        for batch in batches:
            read = [noise_of(text, Words(rows), vectors, matrix) for text, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            lines = _column([[n for n, _ in noise] for noise, _ in read], pa.list_(pa.int32()))
            kinds = _column([[k for _, k in noise] for noise, _ in read], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lines, kinds, _column([p for _, p in read], pa.list_(pa.string()))], ["extract_path", "lines", "kinds", "paragraphs"])

    return run


def repaired(extracts: DataFrame, **options) -> DataFrame:
    """extract_path, lines, kinds (of noise, side by side) and paragraphs of each distinct text."""
    rows = numbered(extracts)
    words, vectors = learn(rows, **options)
    shared = rows.sparkSession.sparkContext.broadcast(vectors)
    known = rows.join(words, "tid", "left").select("extract_path", "text", "words")
    return known.mapInArrow(_apply(shared), "extract_path string, lines array<int>, kinds array<string>, paragraphs array<string>")


def noisy_lines(extracts: DataFrame, **options) -> DataFrame:
    """extract_path, line_no, noise: the distinct noisy lines."""
    rows = repaired(extracts, **options).select("extract_path", F.explode(F.arrays_zip("lines", "kinds")).alias("x"))
    return rows.select("extract_path", F.col("x.lines").alias("line_no"), F.col("x.kinds").alias("noise")).distinct()


def paragraphs(extracts: DataFrame) -> DataFrame:
    """extract_path, paragraph_no (from 1), text: the repaired texts; a path with several texts has the paragraphs of each."""
    rows = repaired(extracts).select("extract_path", F.posexplode("paragraphs").alias("n", "text"))
    return rows.select("extract_path", (F.col("n") + 1).alias("paragraph_no"), "text").distinct()
