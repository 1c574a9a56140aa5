"""The second vocabulary (adaptive platforms): name mentions and trigger rules, as tables that sentences are joined with.

A rule fires in a sentence that holds its trigger without a negation before it; it then joins every mention of its
subject types in the sentence with every mention of its object types (or of one named entity).  All rules run over
all sentences in one plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences

FC, AA, IF, MANIFEST, PROCESS, ARA, FOUNDATION, SERVICES, SERVICE, PACKAGE, MACHINE = "functional_cluster", "adaptive_application", "interface", "manifest", "process", "ara", "platform_foundation", "platform_service", "service", "software_package", "machine"

# Canonical names by type, then abbreviations and other spellings.
NAMES = {
    FC: ("Execution Management", "State Management", "Communication Management", "Diagnostic Management", "Platform Health Management", "Network Management", "Update and Configuration Management", "Identity and Access Management", "Time Synchronization", "Persistency", "Cryptography", "Log and Trace", "Core Types", "Operating System", "Safety"),
    AA: ("Adaptive Application",),
    ARA: ("ARA",),
    FOUNDATION: ("Adaptive Platform Foundation",),
    SERVICES: ("Adaptive Platform Services",),
    MANIFEST: ("Machine Manifest", "Execution Manifest", "Service Instance Manifest", "Application Design"),
    IF: ("ARA interface", "PSE51", "OSI", "ara::com service interface", "C++ interface", "SOME/IP"),
    PROCESS: ("OS process",),
    SERVICE: ("Service",),
    PACKAGE: ("Software Package",),
}
SPELLINGS = {
    "EM": "Execution Management", "SM": "State Management", "CM": "Communication Management", "DM": "Diagnostic Management", "TS": "Time Synchronization",
    "UCM": "Update and Configuration Management", "PHM": "Platform Health Management", "IAM": "Identity and Access Management", "OS": "Operating System", "NM": "Network Management",
    "Adaptive Applications": "Adaptive Application", "Adaptive Platform Service": "Adaptive Platform Services", "Execution manifest": "Execution Manifest",
}
NEGATION = r"(?i)\b(?:do(?:es)? not|not available|is not|are not|no longer|cannot|may not)\b"
MENTION, VERB, STRUCTURAL = 0.75, 0.85, 0.90


@dataclass(frozen=True)
class Rule:
    predicate: str
    trigger: str
    subjects: tuple[str, ...]
    objects: tuple[str, ...]
    confidence: float = VERB
    subject_name: str | None = None
    object_name: str | None = None
    ordered: bool = False  # the subject stands before the object
    fixed: tuple[tuple[str, str], ...] = ()  # objects (type, name) whether or not the sentence names them, if the chunks do


# Trigger patterns, directions and confidences.
RULES = (
    Rule("provides_interface", r"\b(?:provide[sd]?|provides)\b[^.]{0,80}?\binterface[s]?\b", (FC,), (IF,)),
    Rule("runs_on", r"\brun[s]?\s+on(?:\s+top\s+of)?\b", (AA,), (ARA,), STRUCTURAL),
    Rule("belongs_to", r"\b(?:belong[s]? to|belonging to)\b", (FC,), (), fixed=((FOUNDATION, "Adaptive Platform Foundation"), (SERVICES, "Adaptive Platform Services"))),
    Rule("commands", r"\bcommanding\b", (FC,), (FC,), STRUCTURAL, "State Management", "Execution Management"),
    Rule("interacts_with", r"\b(?:interact[s]? with|interacting with|communication between|coordina(?:te|tes|ting))\b", (FC, AA), (FC, AA), ordered=True),
    Rule("implemented_as", r"\b(?:implemented as|implemented with|realize[sd]? in the form of)\b", (FC, AA), (PROCESS,)),
    Rule("configured_by", r"\b(?:configured in|based on|determined by)\b", (FC, AA, MACHINE), (MANIFEST,)),
    Rule("uses_interface", r"\b(?:use[sd]?\s+(?:only\s+)?(?:the\s+)?(?:standard\s+)?|use[s]?\s+)?(?:PSE51\s+)?(?:as\s+)?(?:OS\s+)?interface[s]?\b|\buse[s]?\s+PSE51\b|\buse[s]?\s+the\s+standard\s+ARA\b", (FC, AA), (IF,)),
    Rule("provides_service", r"\b(?:provide[s]?\s+service[s]?|provide[s]? such service[s]?|offer[s]?\s+or\s+consume(?:s)?)\b", (AA, FC), (SERVICE,)),
    Rule("updates", r"\b(?:updat(?:e|es|ing))\b", (FC,), (PACKAGE,), VERB, "Update and Configuration Management"),
)


def key(kind, name):
    """autosar:<type>:<name in lower case, other characters as one underscore>."""
    return F.concat(F.lit("autosar:"), kind, F.lit(":"), F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def _spelled() -> dict[str, tuple[str, str]]:
    known = {n: (t, n) for t, names in NAMES.items() for n in names}
    return known | {s: known[n] for s, n in SPELLINGS.items()}


def split_sentences(chunks: DataFrame, chunk: str = "chunk_id", text: str = "text") -> DataFrame:
    return chunks.select(chunk, F.posexplode(sentences(F.regexp_replace(text, "\\s+", " "))).alias("sentence_no", "sentence"))


def mentions(found: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """chunk, sentence_no, pos, entity_type, name, entity_key: whole-word names, the longest at each place."""
    spelled = _spelled()
    pattern = "|".join(rf"(?<![\w-]){re.escape(n)}(?![\w-])" for n in sorted(spelled, key=lambda n: (-len(n), n)))
    at = found.select(chunk, "sentence_no", F.posexplode(F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0))).alias("pos", "spelling"))
    kinds = F.create_map(*[F.lit(x) for s, (t, _) in spelled.items() for x in (s, t)])
    names = F.create_map(*[F.lit(x) for s, (_, n) in spelled.items() for x in (s, n)])
    out = at.select(chunk, "sentence_no", "pos", kinds[F.col("spelling")].alias("entity_type"), names[F.col("spelling")].alias("name"))
    return out.withColumn("entity_key", key(F.col("entity_type"), F.col("name")))


def entities(chunks: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """entity_key, entity_type, name, confidence, n_mentions."""
    return mentions(split_sentences(chunks, chunk), chunk).groupBy("entity_key", "entity_type", "name").agg(F.lit(MENTION).alias("confidence"), F.count(F.lit(1)).alias("n_mentions"))


def relations(chunks: DataFrame, rules: tuple[Rule, ...] = RULES, chunk: str = "chunk_id") -> DataFrame:
    """subject, predicate, object, confidence, n: facts of all rules, each once with the number of sentences for it."""
    cut = split_sentences(chunks, chunk)
    named = mentions(cut, chunk)
    out = None
    for r in rules:
        before = F.element_at(F.split("sentence", f"(?i){r.trigger}", 2), 1)
        fires = cut.where(F.col("sentence").rlike(f"(?i){r.trigger}") & ~F.right(before, F.lit(88)).rlike(NEGATION)).select(chunk, "sentence_no")
        s = named.where(F.col("entity_type").isin(*r.subjects)).join(fires, [chunk, "sentence_no"])
        o = named.where(F.col("entity_type").isin(*r.objects))
        s = s.where(F.col("name") == r.subject_name) if r.subject_name else s
        o = o.where(F.col("name") == r.object_name) if r.object_name else o
        s = s.select(chunk, "sentence_no", F.col("pos").alias("ps"), F.col("entity_key").alias("subject"))
        if r.fixed:
            named_keys = [key(F.lit(k), F.lit(n)) for k, n in r.fixed]
            held = named.select(F.col("entity_key").alias("object")).distinct()
            pairs = s.select("*", F.explode(F.array(*named_keys)).alias("object")).join(held, "object", "left_semi")
            out_ = pairs.select("subject", F.lit(r.predicate).alias("predicate"), "object", F.lit(r.confidence).alias("confidence"), chunk, "sentence_no").distinct()
            out = out_ if out is None else out.unionByName(out_)
            continue
        pairs = s.join(o.select(chunk, "sentence_no", F.col("pos").alias("po"), F.col("entity_key").alias("object")), [chunk, "sentence_no"]).where("subject <> object")
        pairs = pairs.where("ps < po") if r.ordered else pairs
        part = pairs.select("subject", F.lit(r.predicate).alias("predicate"), "object", F.lit(r.confidence).alias("confidence"), chunk, "sentence_no").distinct()
        out = part if out is None else out.unionByName(part)
    return out.groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
