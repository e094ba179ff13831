"""Variant spellings of names typed by people: merge-and-rematch resolution.

Every spelling is read into a head (the surname, or the word that names a thing),
the words beside it, initials and legal form (:mod:`.names`), with what the counts
of all words tell of its own words: which are given names, slips for a far more
frequent word, or common. Spellings that read the same are one node. Nodes are
blocked by the head with one letter less and by a letter of the words beside it
(two slips in a long head are found where both words lose one letter to be equal), and matched within each block; a block of many nodes is cut into
parts, and each pair of its parts is matched in a task of its own. Matches are
merged over all blocks into components. Then merged components re-enter: the heads
and words of all their spellings are united, and each new head-and-words that the
union tells goes through blocking and matching again; and what says too little to
be matched by itself (an initial and a surname, a surname, the short name of an
organisation) is linked where all the profiles of that head and initial, by all of
their spellings, are one component. Rounds follow until no further merge occurs.

Only keys of the same kind are linked. Rows without key or kind, and names without
a letter, link to nothing. Repeated rows count once. Ambiguous short forms stay
alone. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import names
from .components import connected_components

#: Different names (by their first letters, so that slips in one name count once) beside which a word of things is common.
COMMON, FIRST = 12, 3
#: Nodes of a block that are matched in one task; larger blocks are cut into parts.
BLOCK_ROWS = 2_000
#: Comparisons of a block up to which looking up what to compare costs more than comparing.
DIRECT = 64


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of names with the other words they stand beside."""
    for batch in batches:
        out = []
        for kind, name in zip(batch["kind"], batch["name"]):
            person = kind == "person"
            tokens = (names.person_tokens if person else names.thing_tokens)(name)
            if person and len(tokens) != 2:
                continue
            # a word that stands before many different words is a given name
            out += [(person, False, tokens[0], tokens[1])] if person else [(person, False, t, name) for t in set(tokens)]
            if not person:  # a word beside many different names is common, however often one of them is spelt
                told = {t for t in tokens if names.invented(t)}
                out += [(person, True, t, first) for t in set(tokens) for first in {o[:FIRST] for o in told if o != t}]
        yield pd.DataFrame(out, columns=["person", "spread", "word", "beside"])


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, kind, name -> the words that reading the name asks about."""
    for batch in batches:
        out = []
        for key, kind, name in zip(batch["key"], batch["kind"], batch["name"]):
            person = kind == "person"
            words = set(names.person_tokens(name)) if person else {*names.thing_tokens(name), *names.suffixes(name)}
            out += [(key, kind, person, w) for w in sorted(words)]
        yield pd.DataFrame(out, columns=["key", "kind", "person", "word"])


def _one_edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[[names.edits(a, b, 1) == 1 for a, b in zip(batch["word"], batch["meant"])]]


def _less_a_letter(word: str) -> Column:
    """The word and all it becomes with one letter less."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(F.col(word), F.lit(1), i - 1), F.substr(F.col(word), i + 1)))
    return F.explode(F.array_distinct(F.concat(F.array(word), shorter)))


def word_facts(spellings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, kind, facts): what the counts tell of the words of each spelling; and the counts (person, word, n, common)."""
    rows = spellings.select("kind", "name").mapInPandas(_tokens, "person boolean, spread boolean, word string, beside string").distinct()
    counts = rows.groupBy("person", "word").agg(F.sum((~F.col("spread")).cast("int")).cast("int").alias("n"), (F.sum(F.col("spread").cast("int")) >= COMMON).alias("common"))
    counts = cut(counts.filter((F.col("n") >= 2) | F.col("common")).select("person", "word", F.when(F.col("n") >= 2, F.col("n")).otherwise(0).alias("n"), (F.col("common") & ~F.col("person")).alias("common")))
    asked = cut(spellings.mapInPandas(_asked, "key string, kind string, person boolean, word string"))
    own = asked.select("person", "word").distinct().join(counts, ["person", "word"], "left").select("person", "word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("common", F.lit(False)).alias("common"))
    frequent = counts.filter((F.col("n") >= names.ESTABLISHED) & (F.length("word") >= 3)).select("person", F.col("word").alias("meant"), F.col("n").alias("m"), F.col("common").alias("meant_common"))
    left = own.filter(F.length("word") >= 3).select("person", "word", "n", _less_a_letter("word").alias("part"))
    pairs = left.join(frequent.select("*", _less_a_letter("meant").alias("part")), ["person", "part"]).drop("part")
    pairs = pairs.filter((F.col("word") != F.col("meant")) & (F.col("m") >= F.greatest(F.lit(3), names.RATIO * F.col("n")))).distinct()
    slips = pairs.mapInPandas(_one_edit, pairs.schema).groupBy("person", "word").agg(F.max(F.struct("m", "meant", "meant_common")).alias("slip"))
    facts = own.join(slips, ["person", "word"], "left").filter((F.col("n") > 0) | F.col("common") | F.col("slip").isNotNull())
    told = asked.join(facts, ["person", "word"]).groupBy("key", "kind").agg(F.collect_list(F.struct("word", "n", "common", "slip")).alias("facts"))  # a name's words are few
    return told, counts


def _words_of(facts, nicknames: dict[str, int]) -> names.Words:
    weights, slips, common = dict(nicknames), {}, set()
    for f in facts if facts is not None else ():
        weights[f["word"]] = f["n"]
        if f["common"]:
            common.add(f["word"])
        if f["slip"] is not None:
            slips[f["word"]] = f["slip"]["meant"]
            weights[f["slip"]["meant"]] = f["slip"]["m"]
            if f["slip"]["meant_common"]:
                common.add(f["slip"]["meant"])
    return names.Words(weights, slips, common)


def _read(nicknames):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, kind, name, facts in zip(batch["key"], batch["kind"], batch["name"], batch["facts"]):
                words = _words_of(facts, nicknames.value if kind == "person" else {})
                n = names.read_person(name, words) if kind == "person" else names.read_thing(name, kind, words)
                if n is not None:
                    every = (n.head, *n.words)
                    tells = [i for i, w in enumerate(every) if not i or kind != "person" and w not in words.common and names.invented(w)]
                    out.append((key, kind, f"{kind}|{n.normal}", n.head, list(n.words), [words.weights.get(w, 0) for w in n.words], tells, n.initial, n.legal, n.weak))
            yield pd.DataFrame(out, columns=["key", "kind", "node", "head", "words", "weights", "tells", "initial", "legal", "weak"])

    return run


_BLOCK = "block string, node string, kind string, head string, words array<string>, weights array<int>"


def _block_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes -> one row for each block they are compared in; things by each word that may be their head."""
    for batch in batches:
        out = []
        for node, kind, head, words, weights, tells in zip(*(batch[c] for c in ("node", "kind", "head", "words", "weights", "tells"))):
            every, number = (head, *words), (0, *weights)
            for i in tells:
                own, rest = every[i], [j for j in range(len(every)) if j != i]
                beside = [every[j] for j in rest]
                letters = {w[n] for w in beside for n in range(min(2, len(w)))} or {""}
                parts = names.deletions(own)
                number_of = [int(number[j]) for j in rest]
                for d in parts:
                    out += [(f"{kind}|{d}|{letter}", node, kind, own, beside, number_of) for letter in letters]
        yield pd.DataFrame(out, columns=["block", "node", "kind", "head", "words", "weights"])


class _Forest:
    """Components of the nodes of a block."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def root(self, x: str) -> str:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.root(a), self.root(b)
        self.up.setdefault(b, b)
        self.up[a] = b


def block_edges(kind: str, left: list[tuple[str, names.Name]], right: list[tuple[str, names.Name]] | None) -> Iterator[tuple[str, str]]:
    """Edges that connect the nodes that match in a block, or across its two parts, to the least of them. Only names that share a word
    beside the head less a letter (people) or a first letter of one (things) are compared."""
    person = kind == "person"
    same = names.same_person if person else names.same_thing
    forest = _Forest()
    index: dict[str, list[int]] = {}
    other = left if right is None else right

    def marks(name: names.Name) -> set[str]:
        return {d for w in name.words for d in names.deletions(w)} if person else {w[n] for w in name.words for n in range(min(2, len(w)))} or {""}

    few = len(left) * len(other) <= DIRECT
    for i, (_, name) in enumerate(() if few else other):
        for m in marks(name):
            index.setdefault(m, []).append(i)
    for i, (a, name) in enumerate(left):
        for j in range(i if right is None else len(other)) if few else sorted({j for m in marks(name) for j in index.get(m, ()) if right is not None or j < i}):
            b, found = other[j]
            if a != b and forest.root(a) != forest.root(b) and same(name, found):
                forest.join(a, b)
    least: dict[str, str] = {}
    for x in sorted(forest.up):
        r = least.setdefault(forest.root(x), x)
        if r != x:
            yield r, x


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, low, high) -> edges between nodes; one block, or two parts of one, are held at a time."""
    current, left, right = None, [], []
    edges: set[tuple[str, str]] = set()

    def close() -> None:
        if current is not None:
            kind = current[0].split("|", 1)[0]
            edges.update((min(e), max(e)) for e in block_edges(kind, left, right if current[1] != current[2] else None))

    def take() -> pa.RecordBatch:
        rows = sorted(edges)
        edges.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for block, low, high, part, node, head, words, weights in zip(*(batch.column(c).to_pylist() for c in ("block", "low", "high", "part", "node", "head", "words", "weights"))):
            if (block, low, high) != current:
                close()
                current, left, right = (block, low, high), [], []
            (left if part == low else right).append((node, names.Name(head, tuple(words), weights=tuple(weights))))
        yield take()
    close()
    yield take()


def matches(blocks: DataFrame, block_rows: int) -> DataFrame:
    """a, b: nodes that match in some block."""
    shared = blocks.groupBy("block").count().filter(F.col("count") > 1).select("block", F.ceil(F.col("count") / block_rows).cast("int").alias("parts"))
    rows = blocks.join(shared, "block").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "head", "words", "weights")
    return rows.repartition("block", "low", "high").sortWithinPartitions("block", "low", "high", "node").mapInArrow(_match, "a string, b string")


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of components -> what short forms may call them: (call, near, component)."""
    for batch in batches:
        out = []
        for kind, head, beside, initial, legal, component in zip(*(batch[c] for c in ("kind", "head", "words", "initial", "legal", "component"))):
            if kind == "person":
                tags = {"*"} | {w[0] for w in beside} | ({initial} if initial else set())
            else:
                tags = {f"{beside[0]}|{legal}", f"{beside[0]}|"} if len(beside) > 1 else set()
                if len(beside) > 1:
                    out.append((f"{kind}|{head[0]}{''.join(w[0] for w in beside)}|letters", False, component))
            for tag in tags:
                out.append((f"{kind}|{head}|{tag}", False, component))
                out += [(f"{kind}|{d}|{tag}", True, component) for d in names.deletions(head)]
        yield pd.DataFrame(out, columns=["call", "near", "component"])


def _calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Short forms -> what they may call: (component or node, call, near)."""
    for batch in batches:
        out = []
        for own, kind, head, beside, initial, legal in zip(*(batch[c] for c in ("own", "kind", "head", "words", "initial", "legal"))):
            tag = "letters" if kind != "person" and not len(beside) else f"{beside[0]}|{legal}" if kind != "person" else initial or "*"
            out.append((own, f"{kind}|{head}|{tag}", False))
            if len(head) >= 5 and tag != "letters":
                out += [(own, f"{kind}|{d}|{tag}", True) for d in names.deletions(head)]
        yield pd.DataFrame(out, columns=["own", "call", "near"])


def _rematched(state: DataFrame, changed: DataFrame, blocks: DataFrame, block_rows: int) -> DataFrame:
    """own, found: components that match once the heads and words of each changed component are united."""
    own = state.filter(~F.col("weak")).join(changed, "component", "left_semi")
    heads = own.select("component", "kind", "head").distinct()
    beside = own.groupBy("component", "words").agg(F.first("weights").alias("weights"), F.first("tells").alias("tells"))
    told = heads.join(beside, "component").join(own.select("component", "head", "words").distinct(), ["component", "head", "words"], "left_anti")
    united = told.select(F.concat(F.lit("+"), "component").alias("node"), "kind", "head", "words", "weights", "tells")
    new = cut(united.mapInPandas(_block_keys, _BLOCK))
    if new.isEmpty():
        return state.select(F.col("component").alias("own"), F.col("component").alias("found")).limit(0)
    met = blocks.join(new.select("block").distinct(), "block", "left_semi").join(state.select("node", "component"), "node").select("block", F.concat(F.lit("="), "component").alias("node"), "kind", "head", "words", "weights")
    edges = matches(new.unionByName(met), block_rows).select(F.substring("a", 2, 1 << 30).alias("a"), F.substring("b", 2, 1 << 30).alias("b"))
    return connected_components(edges).filter(F.col("id") != F.col("component")).select(F.col("id").alias("own"), F.col("component").alias("found"))


def _called(state: DataFrame) -> DataFrame:
    """own, found: short forms and the only component that they may call."""
    parts = ["kind", "head", "words", "initial", "legal"]
    short = F.col("component").isNull() | (F.col("kind") == "organization") & (F.size("words") == 1)
    called = state.filter(F.col("component").isNotNull()).select(*parts, "component").mapInPandas(_anchors, "call string, near boolean, component string")
    called = called.groupBy("call", "near").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    own = F.coalesce("component", "node")
    calls = state.filter(short).select(own.alias("own"), *parts).mapInPandas(_calls, "own string, call string, near boolean").distinct()
    hits = calls.join(called, ["call", "near"]).groupBy("own", "near").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # an equal head decides before a near one
    best = hits.groupBy("own").agg(F.min_by(F.struct("low", "high"), "near").alias("best"))
    found = best.filter((F.col("best.low") == F.col("best.high")) & (F.col("best.low") != F.col("own"))).select("own", F.col("best.low").alias("found"))
    # two that call each other are one: the components of what was found
    joined = connected_components(found.select(F.col("own").alias("a"), F.col("found").alias("b")))
    return joined.filter(F.col("id") != F.col("component")).select(F.col("id").alias("own"), F.col("component").alias("found"))


def variant_groups(entities: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, kind, component: the keys whose names could be read, with the group they belong to."""
    spark = entities.sparkSession
    spellings = entities.filter(F.col("key").isNotNull() & F.col("kind").isNotNull()).select("key", F.lower("kind").alias("kind")).distinct()
    # the key holds the name, case-folded and with white space collapsed
    spellings = spellings.withColumn("name", F.when(F.startswith("key", F.concat("kind", F.lit(":"))), F.expr("substring(key, length(kind) + 2)")).otherwise(F.col("key")))
    told, counts = word_facts(spellings)
    full = sorted({f for fs in names.NICKNAMES.values() for f in fs.split()})
    known = {r["word"]: r["n"] for r in counts.filter(F.col("person") & F.col("word").isin(full)).collect()}
    nicknames = spark.sparkContext.broadcast({f: known.get(f, 0) for f in full})  # the fixed list of names
    schema = "key string, kind string, node string, head string, words array<string>, weights array<int>, tells array<int>, initial string, legal string, weak boolean"
    read = cut(spellings.join(told, ["key", "kind"], "left").select("key", "kind", "name", "facts").mapInPandas(_read(nicknames), schema))
    first = [F.first(c).alias(c) for c in ("kind", "head", "words", "weights", "tells", "initial", "weak")]
    nodes = cut(read.groupBy("node").agg(*first, F.max("legal").alias("legal")))

    blocks = cut(nodes.filter(~F.col("weak")).select("node", "kind", "head", "words", "weights", "tells").mapInPandas(_block_keys, _BLOCK))
    joined = connected_components(matches(blocks, block_rows))
    # what is full anchors a component of its own; a short form is anchored once it is linked
    state = cut(nodes.join(joined, nodes["node"] == joined["id"], "left").select(*nodes.columns, F.coalesce("component", F.when(~F.col("weak"), F.col("node"))).alias("component")))
    changed = state.filter(F.col("component").isNotNull()).groupBy("component").count().filter(F.col("count") > 1).select("component")
    while True:
        merged = _rematched(state, changed, blocks, block_rows)
        called = merged.isEmpty()
        if called:
            merged = _called(state)
            if merged.isEmpty():
                break
        merged = cut(merged)
        own = F.coalesce("component", "node")
        state = state.withColumn("own", own).join(merged, "own", "left")
        state = cut(state.withColumn("component", F.coalesce("found", "component")).drop("found", "own"))
        changed = merged.select(F.col("found").alias("component")).distinct()
    state = state.select("node", F.coalesce("component", "node").alias("component"))
    return read.select("key", "kind", "node").join(state, "node").select("key", "kind", "component")


def variant_pairs(entities: DataFrame) -> DataFrame:
    """key_a < key_b: all pairs of keys of one kind in one group."""
    groups = cut(variant_groups(entities))
    a, b = (groups.select(F.col("key").alias(f"key_{s}"), F.col("kind"), F.col("component")) for s in "ab")
    return a.join(b, ["kind", "component"]).filter(F.col("key_a") < F.col("key_b")).select("key_a", "key_b")
