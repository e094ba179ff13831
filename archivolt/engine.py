"""The engine over a warehouse of Parquet tables: each stage reads tables and writes one."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import bundle, catalogue, chunking, cypher, enrich, evaluation, graph, index, manifest, reports, retrieval
from .session import cut
from .sources import extract as ex
from .sources import files as fs
from .sources import routing


class Engine:
    """``Engine(spark, config)``; stages: scan, extract, enrich, bundle, index, graph, drain; then search, get_concept, traverse, cypher."""

    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config()

    def path(self, name: str) -> str:
        return f"{self.config.warehouse.rstrip('/')}/{name}"

    def _versions(self, name: str) -> list[str]:
        """The complete versions of a table, the oldest first. A version counts once Spark has marked it as written."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = path.getFileSystem(context._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
        return [n for n in names if n.startswith("v") and fs.exists(context._jvm.org.apache.hadoop.fs.Path(path, f"{n}/_SUCCESS"))]

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise FileNotFoundError(f"no table {name} in {self.config.warehouse}")
        return self.spark.read.parquet(f"{self.path(name)}/{versions[-1]}")

    def has(self, name: str) -> bool:
        """Whether a table has a complete version; a table that cannot be read is an error, not an empty one."""
        return bool(self._versions(name))

    def write(self, rows: DataFrame, name: str, keep: int = 2, by: str | None = None) -> None:
        """A new version of a table, which readers see once it is complete; older ones but the last are removed."""
        versions = self._versions(name)
        following = int(versions[-1][1:]) + 1 if versions else 1
        writer = rows.repartition(by).write.partitionBy(by) if by else rows.write
        writer.mode("overwrite").parquet(f"{self.path(name)}/v{following:08d}")
        context = self.spark.sparkContext
        for old in versions[: max(0, len(versions) + 1 - keep)]:
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/{old}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    @contextmanager
    def run(self, command: str, run_id: str) -> Iterator[dict]:
        """Records a run: its start at once, its end and what the stage put into the dictionary when it is done."""
        now = lambda: datetime.now(timezone.utc).isoformat(timespec="seconds")
        runs = self.read("runs") if self.has("runs") else self.spark.createDataFrame([], manifest.RUNS)
        self.write(manifest.start_run(runs, run_id, command, now()), "runs")
        stats: dict = {}
        yield stats
        self.write(manifest.finish_run(self.read("runs"), run_id, now(), json.dumps(stats, sort_keys=True)), "runs")

    def scan(self, run_id: str, do_hash: bool = True) -> DataFrame:
        """Walk the roots, upsert what is there, mark what is missing, and hash what is included and has no hash."""
        c = self.config.scan
        seen = fs.scan(self.spark, list(c.roots), c.deny, c.max_file_bytes)
        columns = ", ".join(f"{n} {t}" for n, t in (("path", "string"), ("root", "string"), ("ext", "string"), ("mime", "string"), ("scan_status", "string"), ("size", "bigint"), ("inode", "bigint"), ("mtime", "double"), ("hash", "string"), ("extract_status", "string"), ("extract_path", "string"), ("extract_engine", "string"), ("word_count", "bigint"), ("run_id", "string"), ("first_seen", "string"), ("last_seen", "string")))
        with self.run("scan", run_id) as stats:
            old = self.read("files") if self.has("files") else self.spark.createDataFrame([], columns)
            now = datetime.now(timezone.utc).isoformat(timespec="seconds")
            self.write(manifest.mark_missing(manifest.upsert_stat(old, seen, run_id, now), run_id, list(c.roots)), "files")
            if do_hash:
                rows = self.read("files")
                hashes = fs.hash_files(manifest.needs_hash(rows)).withColumnRenamed("hash", "__hash")
                self.write(rows.join(hashes, "path", "left").withColumn("hash", F.coalesce("hash", "__hash")).drop("__hash"), "files")
            out = self.read("files").groupBy("scan_status").count()
            stats.update({r["scan_status"]: r["count"] for r in out.collect()})  # a handful of states
        return out

    def extract(self) -> DataFrame:
        """Read the text of every pending hash, from the first path that holds it."""
        todo = manifest.pending_extractions(self.read("files"))
        content = todo.join(fs.read_files(todo), "path")
        rows = content.select("hash", "ext", routing.route(F.col("ext"), F.col("mime"), self.config.scan.include_source_code).alias("route"), "content")
        new = ex.extract(rows, self.config.extract.min_chars).withColumn("extract_path", F.concat_ws("/", F.substring("hash", 1, 2), F.concat("hash", F.lit(".md"))))
        self.write(new, "_extracted")
        new = self.read("_extracted")
        old = self.read("extracts").join(new.select("hash"), "hash", "left_anti") if self.has("extracts") else None
        self.write(old.unionByName(new) if old is not None else new, "extracts")
        self.write(manifest.set_extract_result(self.read("files").withColumn("error", F.lit(None).cast("string")), new.select("hash", "status", "extract_path", "engine", "word_count", "error")).drop("error"), "files")
        return new.groupBy("status").count()

    def enrich(self, enricher=enrich.rule_based, limit: int | None = None) -> DataFrame:
        """A record for every extracted text without one, the newest first if there is a ``limit``."""
        empty = self.spark.createDataFrame([], "source_hash string, concept_id string, concept_type string, title string, description string, tags array<string>, entities array<struct<name:string,kind:string>>, sensitivity string, status string, enrich_status string, error string")
        old = self.read("concepts") if self.has("concepts") else empty
        todo = manifest.enrichable(self.read("files"), old).select(F.col("hash").alias("source_hash"), "path", "last_seen")
        if limit is not None:
            todo = todo.orderBy(F.desc("last_seen"), "source_hash").limit(limit)
        texts = todo.join(self.read("extracts").select(F.col("hash").alias("source_hash"), "text"), "source_hash").select("source_hash", F.regexp_replace("path", "^.*/|\\.[^.]*$", "").alias("name"), "text")
        self.write(enrich.enrich(texts, enricher), "_enriched")
        new = self.read("_enriched")
        ids = bundle.allocate_ids(new.filter("enrich_status = 'ok'").join(old.filter("concept_id IS NOT NULL").select("source_hash"), "source_hash", "left_anti"), old.select("concept_id").dropna())
        new = new.join(ids, "source_hash", "left").withColumn("status", F.lit("stable"))
        self.write(manifest.save_concepts(old, new.select(*old.columns)), "concepts")
        return new.groupBy("enrich_status").count()

    def _live(self) -> DataFrame:
        return self.read("concepts").filter("concept_id IS NOT NULL AND coalesce(status, 'stable') <> 'deprecated'")

    def bundle(self) -> DataFrame:
        """Deprecate what lost its files, link, render and validate; the findings."""
        from .sources.bundles import rendered

        gone = manifest.to_deprecate(self.read("files"), self.read("concepts")).select("source_hash", F.lit(True).alias("__gone"))
        rows = self.read("concepts").join(gone, "source_hash", "left").withColumn("status", F.when(F.col("__gone"), "deprecated").otherwise(F.col("status"))).drop("__gone")
        self.write(rows, "concepts")
        b = self.config.bundle
        links = bundle.related(self._live(), b.link_rarity_ceiling, b.max_related, b.min_link_score)
        paths = manifest.representatives(self.read("files")).select(F.col("hash").alias("source_hash"), "path")
        docs = bundle.documents(self._live(), paths, links)
        extra = [F.lit(None).cast("string").alias(c) for c in ("generated_at", "ingest_run")]
        # the whole bundle is written anew, so that documents of no concept are pruned
        self.write(rendered(docs, self._live().select("*", *extra)), "bundle")
        self.write(bundle.indexes(self._live()), "bundle_indexes")
        runs = self.read("runs") if self.has("runs") else self.spark.createDataFrame([], manifest.RUNS)
        self.write(bundle.log_days(runs.select(F.substring("started_at", 1, 10).alias("day"), F.col("started_at").alias("seq"), F.concat_ws(" ", "command", "run_id").alias("line"))), "bundle_log")
        return bundle.validate(self.read("bundle"))

    def validate(self) -> DataFrame:
        """The findings on the bundle as it is."""
        return bundle.validate(self.read("bundle"))

    def report(self) -> dict[str, DataFrame]:
        """What the census and the extraction came to."""
        files = self.read("files")
        return {"scan_status": reports.scan_status(files), "extensions": reports.top_extensions(files), "duplication": reports.duplication(files), "extraction": reports.extraction_status(files), "success": reports.success_rate(files)}

    def index(self, embed=None, whole: bool = False) -> DataFrame:
        """Chunks, postings and lengths of the concepts that changed since the last time (of all with ``whole``), and
        statistics; vectors of the changed chunks if ``embed`` (texts -> vectors) is given. Unchanged concepts are
        neither read nor split again."""
        live = self._live()
        extracts = self.read("extracts").select(F.col("hash").alias("source_hash"), "text")
        told = live.select("concept_id", "source_hash", "concept_type", "sensitivity", "title", F.col("description").alias("summary"))
        # a text never changes under its hash: the hash stands for it
        now = index.fingerprints(told)
        tables = ("chunks", "postings", "lengths", "indexed")
        fresh_start = whole or not all(self.has(t) for t in tables)
        if fresh_start:
            changed, stale = now.select("concept_id"), None
        else:
            changed, stale = (cut(x) for x in index.changed_concepts(now, self.read("indexed")))
        c = self.config.chunking
        texts = told.join(changed, "concept_id", "left_semi").join(extracts, "source_hash", "left")
        new = chunking.chunk_documents(texts.select("concept_id", "summary", "text"), "markdown", c.max_tokens, c.overlap_ratio)
        new = cut(new.join(told.drop("summary"), "concept_id").withColumn("source", F.lit("local")))
        built = index.build_index(new)
        owner = new.select("chunk_id", "concept_id")
        fresh = {"chunks": new, "postings": built.postings.join(owner, "chunk_id").withColumn("part", index.term_part(F.col("term"))), "lengths": built.lengths.join(owner, "chunk_id")}
        if embed is not None:
            vector = F.pandas_udf(embed, "array<float>")
            fresh["vectors"] = new.select("chunk_id", "concept_id", vector(chunking.embed_input(F.col("title"), F.col("heading_path"), F.col("text"))).alias("vector"))
        elif self.has("vectors"):  # vectors of what changed are gone rather than stale
            fresh["vectors"] = self.read("vectors").limit(0)
        for name, rows in fresh.items():
            self.write(rows if fresh_start or not self.has(name) else index.replace_rows(self.read(name), stale, rows), name, by="part" if name == "postings" else None)
        self.write(index.document_frequencies(self.read("postings")), "terms")
        self.write(self.read("lengths").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")), "stats")
        self.write(now, "indexed")
        return self.read("chunks").agg(F.count(F.lit(1)).alias("chunks")).withColumn("changed", F.lit(changed.count()))

    def graph_tables(self, aliases: list[tuple[str, str]] | None = None) -> cypher.Graph:
        """Concepts, files, entities and tags with all their edges. ``aliases``: (alias key, key) of entities."""
        from .operators.orphans import link_concept

        live = self._live()
        ents = catalogue.concept_entities(live)
        if aliases:
            known = self.spark.createDataFrame(aliases, "key string, __key string")
            ents = ents.join(known, "key", "left").withColumn("key", F.coalesce("__key", "key")).drop("__key")
        links = self.read("bundle").select(F.regexp_replace("path", r"\.md$", "").alias("from_id"), F.explode(F.regexp_extract_all("text", F.lit(r"\[([^\]]*)\]\(([^)]+)\)"), F.lit(2))).alias("target"))
        known = live.select(F.col("concept_id").alias("to_id"))
        edges = links.select("from_id", link_concept(F.col("from_id"), F.col("target")).alias("to_id")).dropna().distinct().join(known, "to_id", "left_semi").select("from_id", "to_id")
        two = lambda rows, b: rows.select(F.col("concept_id").alias("from_id"), F.col(b).alias("to_id")).distinct()
        files = manifest.representatives(self.read("files")).join(live.select(F.col("source_hash").alias("hash")).distinct(), "hash", "left_semi")
        children = graph.child_edges(live.select("concept_id")).toDF("from_id", "to_id")
        derived = live.join(files.select(F.col("hash").alias("source_hash")), "source_hash", "left_semi").select(F.col("concept_id").alias("from_id"), F.col("source_hash").alias("to_id")).distinct()
        nodes = {
            "Concept": (live.select("concept_id", F.col("concept_type").alias("type"), "title", "sensitivity"), "concept_id"),
            "File": (files.select("hash", "path", "ext", "size", "copies"), "hash"),
            "Entity": (ents.groupBy("key").agg(F.min("name").alias("name"), F.min("kind").alias("kind"), F.countDistinct("concept_id").alias("occurrence_count")), "key"),
            "Tag": (catalogue.concept_tags(live).groupBy("tag").agg(F.count(F.lit(1)).alias("concept_count")), "tag"),
        }
        return cypher.Graph(
            nodes,
            {
                "LINKS_TO": (edges, "Concept", "Concept"), "CHILD_OF": (children, "Concept", "Concept"), "DERIVED_FROM": (derived, "Concept", "File"),
                "MENTIONS": (two(ents, "key"), "Concept", "Entity"), "TAGGED_AS": (two(catalogue.concept_tags(live), "tag"), "Concept", "Tag"),
            },
        )

    def entity_review(self, most: int = 200) -> str:
        """A markdown table of entities that may be the same, the surest and most frequent first."""
        nodes = self.graph_tables().nodes["Entity"][0]
        rows = graph.review_order(graph.duplicate_candidates(nodes), nodes).limit(most).collect()  # at most ``most``
        lines = [f"| {r['key_a']} | {r['key_b']} | {r['reason']} |" for r in rows]
        return "\n".join(["| One | Other | Why |", "| --- | --- | --- |", *lines])

    def evaluate(self, questions: list[tuple[str, str, list[str]]]) -> dict:
        """Hit rates, reciprocal rank, abstention and confidence for questions of :func:`.config.load_questions`."""
        asked = self.spark.createDataFrame(questions, "qid string, q string, concepts array<string>")
        built = index.KeywordIndex(self.read("postings").drop("concept_id", "part"), self.read("lengths").drop("concept_id"), self.read("stats"), self.read("terms"))
        hits = cut(retrieval.search(self.read("chunks"), built, asked.select("qid", "q"), None, self.graph_tables().edges["LINKS_TO"][0], retrieval.lexical_overlap).select("qid", "concept_id", "place", "score"))
        best = hits.groupBy("qid").agg(F.max("score").alias("best_score"))
        return evaluation.metrics(evaluation.question_results(asked, evaluation.concept_ranks(hits), best), self.config.retrieval.weak_score).first().asDict()

    def cypher(self, text: str) -> DataFrame:
        return cypher.run(self.graph_tables(), text)

    def drain(self, run_id: str, limit: int | None = None, budget_seconds: float | None = None, part: int = 50, embed=None) -> dict:
        """One round of catching up: scan, extract, at most ``limit`` records, bundle, index. With a budget, records are
        made in parts of ``part`` until it is spent; what is left waits for the next round, as its state is in the tables."""
        began, done = time.monotonic(), 0
        most = self.config.watch.drain_max if limit is None else limit
        with self.run("drain", run_id) as stats:
            self.scan(f"{run_id}-scan")
            self.extract()
            while done < most and (budget_seconds is None or time.monotonic() - began < budget_seconds):
                made = sum(r["count"] for r in self.enrich(limit=min(part if budget_seconds is not None else most, most - done)).collect())
                done += made
                if not made or budget_seconds is None:
                    break
            self.bundle()
            changed = self.index(embed).first()["changed"]
            left = manifest.enrichable(self.read("files"), self.read("concepts")).count()
            stats.update(enriched=done, changed=changed, waiting=left)
        return stats

    def search(self, text: str, qvec: list[float] | None = None, limit: int = 0, edges: bool = True, **filters: str | None) -> DataFrame:
        """The best hits for one query, with those linked to them unless ``edges`` is false; with a query vector and stored vectors both rankings are fused."""
        q = self.spark.createDataFrame([("q", text, qvec)], "qid string, q string, qvec array<double>")
        # only the parts of the postings that may hold the question's terms are read
        terms = [r["term"] for r in retrieval.question_terms(q).collect()]  # those of one question
        parts = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(index.term_part(F.col("term"))).distinct().collect()]
        postings = self.read("postings").filter(F.col("part").isin(parts) & F.col("term").isin(terms)).drop("concept_id", "part")
        built = index.KeywordIndex(postings, self.read("lengths").drop("concept_id"), self.read("stats"), self.read("terms").filter(F.col("term").isin(terms)))
        vectors = self.read("vectors") if qvec is not None and self.has("vectors") else None
        links = self.graph_tables().edges["LINKS_TO"][0] if edges else None
        return retrieval.search(self.read("chunks"), built, q, vectors, links, limit=limit or self.config.retrieval.limit, **filters)

    # Answers as plain dictionaries, for tools and services.

    def search_knowledge(self, query: str, limit: int = 10, **filters: str | None) -> dict:
        if not query.strip():
            return {"error": "the query is empty", "results": []}
        hits = self.search(query, limit=min(max(limit, 1), 50), **filters)
        rows = retrieval.group_hits(hits).orderBy("place").collect()  # at most 50
        best = max((r["score"] for r in rows), default=0.0)
        return {"query": query, "weak": bool(rows) and best < self.config.retrieval.weak_score, "results": [r.asDict(recursive=True) for r in rows]}

    def get_concept(self, concept_id: str) -> dict:
        wanted = concept_id.strip().removesuffix(".md").strip("/")
        row = self._live().filter(F.col("concept_id") == wanted).first()
        return row.asDict(recursive=True) if row else {"error": f"no concept {wanted}"}

    def traverse(self, concept_id: str, hops: int = 1, edge_types: tuple[str, ...] = ("LINKS_TO", "MENTIONS", "TAGGED_AS", "CHILD_OF", "DERIVED_FROM"), limit: int = 50) -> dict:
        tables = self.graph_tables().edges
        if unknown := sorted(set(edge_types) - set(tables)):
            return {"error": f"unknown edge types: {', '.join(unknown)}"}
        named = {t: tables[t][0].select(F.col("from_id").alias("concept_id"), F.col("to_id").alias("key")) for t in edge_types if t not in ("LINKS_TO", "CHILD_OF")}
        between = [tables[t][0] for t in ("LINKS_TO", "CHILD_OF") if t in edge_types]  # from concept to concept
        links = reduce(DataFrame.unionByName, between) if between else tables["LINKS_TO"][0].limit(0)
        rows = graph.traverse(concept_id.strip().removesuffix(".md").strip("/"), links, named, hops, limit).collect()  # at most 200
        return {"concept_id": concept_id, "neighbours": [{"concept_id": r["concept_id"], "reasons": list(r["reasons"])} for r in rows]}
