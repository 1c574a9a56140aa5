"""Projects on disk: documents, chunks and vectors by collection, registry, findings, comparisons, reviews and an audit log,
and the entry points that read and write them.

Every table is a keyed Parquet store under one root (see `sources.io.KeyedStore`): writing the same thing twice changes
nothing.  Queries take all versions at once; entry points that name a version filter by it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions import text as T
from .operators import adaptive, answer, chunking, diff, extract, findings, graph, profiles, registry, retrieval
from .sources import pdf
from .sources.io import KeyedStore, append_audit
from .sources.shared import store

KEYS = {
    "documents": ["sha256"],
    "versions": ["version"],
    "chunks": ["collection", "chunk_id"],
    "vectors": ["collection", "chunk_id"],
    "entities": ["version", "entity_key"],
    "facts": ["version", "fact_key"],
    "findings": ["version", "finding_id"],
    "runs": ["run_id"],
    "comparisons": ["base_version", "target_version"],
    "queries": ["query_id"],
}
LIMITATIONS = ("Findings follow from rules over extracted facts; what a document does not state is not found.", "Impacts are potential: reachability is not behaviour.", "A table's section is that of its place on the page.")


class WorkspaceError(ValueError):
    """A request that cannot be met, with the reason."""


class Workspace:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings.load()
        self.tables = {name: KeyedStore(spark, f"{self.root}/{name}", key) for name, key in KEYS.items()}

    # --- tables ---

    def table(self, name: str) -> DataFrame:
        found = self.tables[name].read()
        if found is None:
            raise WorkspaceError(f"nothing is stored in {name!r} yet")
        return found

    def has(self, name: str) -> bool:
        return self.tables[name].read() is not None

    def log(self, action: str, **details) -> None:
        """Append to the audit log; a log that can't be written never stops the work."""
        try:
            append_audit(self.spark, f"{self.root}/audit", action, json.dumps(details, sort_keys=True, default=str))
        except Exception:  # by contract the audit never raises
            pass

    def audit(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/audit").orderBy("at")

    def _begin(self, kind: str, version: str, **params) -> str:
        run_id = f"{kind}-{version}-{(self.table('runs').count() if self.has('runs') else 0) + 1:06d}"
        self._run(run_id, kind, version, "running", params)
        return run_id

    def _run(self, run_id: str, kind: str, version: str, status: str, params: dict) -> None:
        row = self.spark.createDataFrame([(run_id, kind, version, status, json.dumps(params, sort_keys=True, default=str))], "run_id string, kind string, version string, status string, params string")
        self.tables["runs"].upsert(row.withColumn("at", F.current_timestamp()))
        self.log(f"{kind}_{status}", run_id=run_id, version=version, **params)

    def latest_run(self, kind: str, version: str) -> str | None:
        if not self.has("runs"):
            return None
        return self.table("runs").where((F.col("kind") == kind) & (F.col("version") == version)).agg(F.max("run_id")).first()[0]

    # --- versions ---

    def versions(self) -> DataFrame:
        """Every version with its document, and whether a registry of it exists; in order of document and label."""
        v = self.table("versions").join(self.table("documents").select("sha256", "title"), "sha256", "left")
        flags = self.table("facts").select("version").distinct().withColumn("has_registry", F.lit(True)) if self.has("facts") else None
        v = v.join(flags, "version", "left").withColumn("has_registry", F.coalesce("has_registry", F.lit(False))) if flags is not None else v.withColumn("has_registry", F.lit(False))
        return v.orderBy("document_name", "version")

    def _version(self, label: str) -> dict:
        known = {r["version"]: r.asDict() for r in self.table("versions").where(F.col("version") == label).limit(1).collect()}
        if label not in known:
            names = [r[0] for r in self.table("versions").select("version").orderBy("version").limit(20).collect()]
            raise WorkspaceError(f"unknown version {label!r}; known are {', '.join(names)}")
        return known[label]

    def compare_gate(self, base: str, target: str) -> str:
        """The profile of two versions that may be compared; else an error that says why not."""
        if base == target:
            raise WorkspaceError("a comparison needs two versions")
        one, two = self._version(base), self._version(target)
        if one["profile"] != two["profile"]:
            raise WorkspaceError(f"profiles differ: {one['profile']} and {two['profile']}")
        if one["profile"] == profiles.GENERIC:
            raise WorkspaceError("generic documents have no registry to compare")
        if one["sha256"] == two["sha256"]:
            raise WorkspaceError("both versions are the same content")
        return one["profile"]

    # --- index ---

    def index(self, documents: DataFrame, collection: str = "main", rebuild: bool = False) -> DataFrame:
        """Chunk documents, embed the chunks, store both; the summary by document.  Collections never mix."""
        if rebuild:
            self.reset(collection)
        made = store(chunking.chunk(documents, self.settings.chunk_tokens, self.settings.chunk_overlap).withColumn("collection", F.lit(collection)), "chunks")
        self.tables["chunks"].upsert(made)
        self.tables["vectors"].upsert(retrieval.hash_vectors(made, "chunk_id", "text").withColumn("collection", F.lit(collection)))
        self.log("indexed", collection=collection)
        return chunking.summary(made)

    def chunks(self, collection: str = "main", version: str | None = None) -> DataFrame:
        found = self.table("chunks").where(F.col("collection") == collection)
        return found.where(F.col("version") == version) if version else found

    def count(self, collection: str = "main") -> int:
        return self.chunks(collection).count() if self.has("chunks") else 0

    def reset(self, collection: str = "main") -> None:
        for name in ("chunks", "vectors"):
            self.tables[name].clear(f"collection = '{collection}'")

    def page_text(self, version: str, page: int, collection: str = "main") -> str:
        """The chunks that a page has part in, in order."""
        on = retrieval.on_pages(self.chunks(collection, version), (page, page))
        row = on.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_seq", "text"))), lambda x: x["text"]), "\n\n").alias("t")).first()
        return row["t"] or ""

    # --- questions ---

    def retrieve(self, questions: DataFrame, top_k: int | None = None, collection: str = "main", mode: str = "hybrid", **filters) -> DataFrame:
        """The best chunks of every question, with their text and place; what was asked is kept in the query log."""
        c = self.chunks(collection)
        k = top_k or self.settings.top_k
        hits = store(retrieval.retrieve(c, questions, k, filters or None, mode), "hits")
        n = hits.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_hits"))
        asked = questions.join(n, "question_id", "left").select(F.expr("uuid()").alias("query_id"), "question", F.lit(mode).alias("mode"), F.lit(k).alias("top_k"), F.lit(json.dumps(filters, sort_keys=True)).alias("filters"), F.coalesce("n_hits", F.lit(0).cast("long")).alias("n_hits"))
        self.tables["queries"].upsert(asked)
        return hits.join(c.select("chunk_id", "text", "section_no", "section_title", "page_start", "page_end", "version"), "chunk_id").orderBy("question_id", "rank")

    def ask(self, questions: DataFrame, top_k: int | None = None, collection: str = "main", generate: Callable[[str, str], str] | None = None, **filters) -> DataFrame:
        made = answer.provider(generate) if generate else None
        return answer.ask(questions, self.chunks(collection), top_k or self.settings.top_k, filters or None, generate=made, force_first=self.settings.force_first_citation, write=store, **self.settings.gate())

    # --- registry ---

    def extract(self, version: str | None = None, collection: str = "main", min_confidence: float | None = None, generate: Callable[[str, str], str] | None = None, reset: bool = False, persist: bool = True) -> dict[str, DataFrame]:
        """Entities and facts of the structured versions of a collection, each by its profile."""
        c = self.chunks(collection, version)
        profile = self.table("versions").select("version", "profile") if self.has("versions") else None
        floor = self.settings.min_confidence if min_confidence is None else min_confidence
        c = c.join(profile, "version", "left").withColumn("profile", F.coalesce("profile", F.lit(profiles.APPLICATION))) if profile is not None else c.withColumn("profile", F.lit(profiles.APPLICATION))
        c = store(c, "chunks")
        made = extract.run(c.where(F.col("profile") == profiles.APPLICATION).drop("profile"), floor, answer.provider(generate) if generate else None, store)
        entities = made["entities"].select("version", "entity_key", "entity_type", F.coalesce(F.col("attributes")["name"], F.lit("")).alias("name"), F.map_filter("attributes", lambda _, v: v != "").alias("attributes"), "confidence", "provenance")
        facts = made["facts"].select("version", "fact_key", "subject", "predicate", "object", "object_value", "confidence", "provenance")
        other = c.where(F.col("profile") == profiles.ADAPTIVE)
        if not other.isEmpty():
            e, f = adaptive_registry(other)
            entities, facts = entities.unionByName(e), facts.unionByName(f)
        out = {"entities": store(entities, "entities"), "facts": store(facts, "facts"), "issues": made["issues"], "stats": made["stats"]}
        if persist:
            run_id = self._begin("extraction", version or "*", floor=floor)
            if reset:
                self.clear_registry(version)
            for name in ("entities", "facts"):
                self.tables[name].upsert(out[name])
            self._run(run_id, "extraction", version or "*", "finished", {})
        return out

    def clear_registry(self, version: str | None = None, adaptive_only: bool = False) -> None:
        where = f"version = '{version}'" if version else "true"
        self.tables["entities"].clear(where + (" and entity_key like 'autosar:%'" if adaptive_only else ""))
        self.tables["facts"].clear(where + (" and subject like 'autosar:%'" if adaptive_only else ""))
        self.log("registry_cleared", version=version or "*")

    def registry(self, version: str) -> tuple[DataFrame, DataFrame]:
        """Facts and entities of a version."""
        here = F.col("version") == version
        f, e = self.table("facts").where(here), self.table("entities").where(here)
        if e.isEmpty():
            raise WorkspaceError(f"no registry of version {version!r}")
        return f, e

    def query_registry(self, version: str, entity: str | None = None, related: str | None = None, predicate: str | None = None, fact: str | None = None, limit: int = 50) -> DataFrame:
        """One of: the entity of a key or id, the facts of an id, of a predicate or of a key, or the counts by type."""
        f, e = self.registry(version)
        if entity:
            found = graph.resolve_keys(self.spark.createDataFrame([(entity,)], "ident string"), e)
            return e.join(found.where("entity_key is not null").select("entity_key"), "entity_key", "left_semi")
        if related:
            return graph.facts_of_id(f, related.split(":")[-1]).limit(limit)
        if predicate:
            return f.where(F.col("predicate") == predicate).orderBy("fact_key").limit(limit)
        if fact:
            return f.where(F.col("fact_key") == fact)
        return registry.counts(e, f)

    def graph(self, version: str) -> graph.Graph:
        f, e = self.registry(version)
        return graph.Graph(f, e, store)

    # --- findings ---

    def analyze(self, version: str, only: tuple[str, ...] = (), persist: bool = False, reset: bool = False) -> DataFrame:
        """Findings of a version by the detectors of its profile; stored ones keep their review state and vanished ones go."""
        f, e = self.registry(version)
        profile = self._version(version)["profile"] if self.has("versions") else profiles.APPLICATION
        found = findings.run(f, e, version, findings.PROFILES["adaptive" if profile == profiles.ADAPTIVE else "application"], only=only)
        if not persist:
            return found
        run_id = self._begin("findings", version, only=only)
        if reset:
            self.clear_findings(version)
        found = store(found.withColumn("version", F.lit(version)), "findings")
        if self.has("findings"):
            before = self.table("findings").where(F.col("version") == version).select("finding_id", F.col("status").alias("__s"))
            found = store(found.join(before, "finding_id", "left").withColumn("status", F.coalesce("__s", "status")).drop("__s"), "findings")
        self.tables["findings"].clear(f"version = '{version}'")
        self.tables["findings"].upsert(found.withColumn("run_id", F.lit(run_id)))
        self._run(run_id, "findings", version, "finished", {"n": found.count()})
        return found

    def findings(self, version: str, **chosen) -> DataFrame:
        return findings.select(self.table("findings").where(F.col("version") == version), **chosen).orderBy("finding_type", F.array_join("entity_keys", ","), "finding_id")

    def review(self, version: str, finding_id: str, status: str) -> None:
        if status not in findings.STATUSES:
            raise WorkspaceError(f"unknown status {status!r}")
        row = self.table("findings").where((F.col("version") == version) & (F.col("finding_id") == finding_id))
        if row.isEmpty():
            raise WorkspaceError(f"no finding {finding_id!r} in version {version!r}")
        self.tables["findings"].upsert(store(row.withColumn("status", F.lit(status)), "review"))
        self.log("reviewed", version=version, finding_id=finding_id, status=status)

    def clear_findings(self, version: str) -> None:
        self.tables["findings"].clear(f"version = '{version}'")
        self.log("findings_cleared", version=version)

    # --- comparisons ---

    def compare(self, base: str, target: str, depth: int | None = None, persist: bool = False, change_type: str | None = None) -> dict[str, DataFrame]:
        if self.has("versions"):
            self.compare_gate(base, target)
        (bf, be), (tf, te) = self.registry(base), self.registry(target)
        depth = self.settings.impact_depth if depth is None else depth
        out = diff.compare(bf, tf, be, te, (base, target), depth, write=store)
        if persist:
            totals = {f"{r['kind']}.{r['name']}": r["n"] for r in out["summary"].collect()}  # a row a kind
            row = self.spark.createDataFrame([(base, target, depth, json.dumps(totals, sort_keys=True))], "base_version string, target_version string, depth int, summary string")
            self.tables["comparisons"].upsert(row)
            for name in ("entity_changes", "relationship_changes", "impacts", "stale_references"):
                out[name].write.mode("overwrite").parquet(f"{self.root}/comparison/{base}/{target}/{name}")
            self.log("compared", base=base, target=target, depth=depth)
        if change_type:
            for name in ("entity_changes", "relationship_changes"):
                out[name] = out[name].where(F.col("change_type") == change_type)
        return out

    def load_comparison(self, base: str, target: str) -> dict[str, DataFrame] | None:
        pair = (F.col("base_version") == base) & (F.col("target_version") == target)
        if not self.has("comparisons") or self.table("comparisons").where(pair).isEmpty():
            return None
        return {name: self.spark.read.parquet(f"{self.root}/comparison/{base}/{target}/{name}") for name in ("entity_changes", "relationship_changes", "impacts", "stale_references")} | {"comparison": self.table("comparisons").where(pair)}

    def clear_comparison(self, base: str, target: str) -> None:
        self.tables["comparisons"].clear(f"base_version = '{base}' and target_version = '{target}'")
        self.log("comparison_cleared", base=base, target=target)

    # --- uploads ---

    def upload(self, files: DataFrame, version: str | None = None, profile: str | None = None, reset: bool = False, collection: str = "uploads", reader=pdf.read, tables: DataFrame | None = None) -> DataFrame:
        """name, sha256, status, version, profile, detail, a row per file (path, name, content): new ones are read, registered,
        indexed and, if their profile is a structured one, extracted.

        A file that is empty, too large or no PDF, or cannot be read, is rejected with the reason; content that is stored
        already, or comes twice, is a duplicate.  A version label that is taken gets the next free number.
        """
        size = F.length("content")
        bad = F.when(size == 0, "empty file").when(size > self.settings.max_upload_bytes, "file too large").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not a PDF")
        given = files.withColumn("sha256", F.sha2("content", 256)).withColumn("bad", bad)
        stored = self.table("documents").select("sha256").withColumn("old", F.lit(True)) if self.has("documents") and not reset else None
        given = given.join(stored, "sha256", "left") if stored is not None else given.withColumn("old", F.lit(None).cast("boolean"))
        first = given.where("bad is null").groupBy("sha256").agg(F.min("path").alias("first"))
        given = given.join(first, "sha256", "left").withColumn("again", F.col("old").isNotNull() | (F.col("path") != F.col("first")))
        fresh = given.where("bad is null and not again")
        read = store(pdf.scan(fresh, reader).join(fresh.select("path", "name"), "path"), "scans")
        good = read.where("error is null")
        lines = F.flatten(F.transform("pages", lambda p: p["lines"]))
        guess = T.guess_version(F.concat_ws(" ", F.col("name"), F.array_join(F.slice(lines, 1, 40), " ")))
        label = F.lit(version) if version else F.when(guess == "", F.concat(F.lit("upload-"), F.substring("sha256", 1, 8))).otherwise(guess)
        docs = good.select(F.col("name").alias("document_name"), "sha256", F.coalesce(F.nullif(F.col("metadata")["title"], F.lit("")), F.col("name")).alias("title"), F.size("pages").alias("page_count"), "pages", label.alias("label"))
        taken = self.table("versions").select("label", "n", "sha256") if self.has("versions") else self.spark.createDataFrame([], "label string, n int, sha256 string")
        last = taken.join(docs.select("sha256"), "sha256", "left_anti").groupBy("label").agg(F.max("n").alias("used"))
        docs = docs.join(last, "label", "left").withColumn("n", (F.coalesce("used", F.lit(0)) + F.row_number().over(registry.Window.partitionBy("label").orderBy("sha256"))).cast("int"))
        docs = docs.withColumn("version", F.when(F.col("n") == 1, F.col("label")).otherwise(F.concat_ws("-", "label", F.col("n").cast("string"))))
        none = F.array().cast("array<struct<page_no:int,table_index:int,headers:array<string>,rows:array<array<string>>>>")
        docs = docs.join(tables.select("sha256", "tables"), "sha256", "left").withColumn("tables", F.coalesce("tables", none)) if tables is not None else docs.withColumn("tables", none)
        docs = store(docs, "documents")
        kind = profiles.detect(profiles.texts(docs)).select("sha256", "profile", F.col("confidence").alias("profile_confidence"))
        kind = kind.withColumn("profile", F.lit(profile)).withColumn("profile_confidence", F.lit(1.0)) if profile else kind
        docs = store(docs.join(kind, "sha256"), "documents")
        self.tables["documents"].upsert(docs.select("sha256", "document_name", "title", "page_count"))
        self.tables["versions"].upsert(docs.select("version", "label", "n", "sha256", "document_name", "profile", "profile_confidence"))
        if not docs.isEmpty():
            self.index(docs.select("document_name", "version", "sha256", "pages", "tables"), collection)
            for v in [r["version"] for r in docs.where(F.col("profile").isin(*profiles.STRUCTURED)).select("version").collect()]:  # the uploads of this call
                self.extract(v, collection, reset=reset)
        done = docs.select("sha256", "version", "profile")
        report = given.select("path", "name", "sha256", "bad", "again").join(read.select("path", "error"), "path", "left").join(done, "sha256", "left")
        status = F.when(F.col("bad").isNotNull(), "rejected").when(F.col("again"), "duplicate").when(F.col("error").isNotNull(), "rejected").otherwise("ready")
        out = store(report.select("name", "sha256", status.alias("status"), F.when(status == "ready", F.col("version")).alias("version"), F.when(status == "ready", F.col("profile")).alias("profile"), F.coalesce("bad", "error", F.lit("")).alias("detail")), "uploads")
        self.log("uploaded", **{r["status"]: r["n"] for r in out.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()})
        return out

    # --- report ---

    def report(self, version: str, base: str | None = None, target: str | None = None) -> dict[str, DataFrame]:
        """Sections of a report, a table each: versions, architecture, entities, relationships, findings, changes, impacts,
        evidence (the first fact of each chunk), limitations."""
        f, e = self.registry(version)
        g = graph.Graph(f, e, store)
        out = {"versions": self.versions()} if self.has("versions") else {}
        out |= {"architecture": g.statistics(), "entities": e.orderBy("entity_key"), "relationships": f.orderBy("subject", "fact_key"), "findings": self.analyze(version)}
        if base and target:
            c = self.compare(base, target)
            cols = ["change_id", "change_type"]
            out["changes"] = c["entity_changes"].select(*cols, F.col("entity_key").alias("key")).unionByName(c["relationship_changes"].select(*cols, F.concat_ws("|", *diff.TRIPLE).alias("key")))
            out |= {"summary": c["summary"], "impacts": c["impacts"].withColumn("path", diff.render_path(F.col("path")))}
        out["evidence"] = answer.first_evidence(f.withColumn("chunk", F.coalesce("provenance.source_chunk_id", "fact_key")), ("chunk",)).select("fact_key", "provenance.*")
        out["limitations"] = self.spark.createDataFrame([(x,) for x in LIMITATIONS], "limitation string")
        return out

    def write_report(self, sections: dict[str, DataFrame], path: str) -> None:
        """Each section as JSON lines; findings, changes and impacts also as CSV, keys joined by semicolons."""
        for name, df in sections.items():
            df.write.mode("overwrite").json(f"{path}/{name}.json")
        flat = {"findings": answer.csv_rows, "changes": lambda d: d, "impacts": lambda d: d.drop("entity_type")}
        for name, project in flat.items():
            if name in sections:
                project(sections[name]).write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")


def adaptive_registry(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and facts of the second vocabulary, of each version, with the provenance of their first chunk."""
    es, fs = [], []
    for v in [r[0] for r in chunks.select("version").distinct().collect()]:  # the versions of one request
        here = chunks.where(F.col("version") == v)
        none = F.lit(None).cast("struct<document_name:string,version_label:string,section_no:string,section_title:string,page_start:int,page_end:int,source_chunk_id:string>")
        e = adaptive.entities(here).select(F.lit(v).alias("version"), "entity_key", "entity_type", "name", F.create_map(F.lit("name"), F.col("name")).alias("attributes"), "confidence", none.alias("provenance"))
        f = adaptive.relations(here).select(F.lit(v).alias("version"), F.concat_ws("|", "subject", "predicate", "object").alias("fact_key"), "subject", "predicate", "object", F.lit("").alias("object_value"), "confidence", none.alias("provenance"))
        es.append(e)
        fs.append(f.join(e.select(F.col("entity_key").alias("subject")), "subject", "left_semi").join(e.select(F.col("entity_key").alias("object")), "object", "left_semi").select(f.columns))
    return reduce(DataFrame.unionByName, es), reduce(DataFrame.unionByName, fs)
