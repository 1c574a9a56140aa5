"""Document profiles: what kind of document a text is, by evidence, and what that kind allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ingest

APPLICATION, ADAPTIVE, GENERIC = "application_hld", "autosar_adaptive_platform", "generic"
STRUCTURED = (APPLICATION, ADAPTIVE)
# Signals of each profile (structural, prose), caps and divisors of the two, least scores, divisors of confidence.
SIGNALS = {
    APPLICATION: (
        {"component_id": r"(?<![\w-])C-\d{2}(?![\w-])", "interface_id": r"(?<![\w-])IF-\d{2}(?![\w-])", "port_id": r"(?<![\w-])P-\d{3}(?![\w-])", "signal_id": r"(?<![\w-])SG-\d{3}(?![\w-])", "dependency_id": r"(?<![\w-])DEP-\d{2}(?![\w-])", "flow_id": r"(?<![\w-])FL-\d(?![\w-])"},
        {"sr_cs_interface": r"\b(?:S-R|C-S) interface\b", "provider_line": r"\bProvider:\s*C-\d{2}", "swc_bsw_layer": r"\((?:SWC|BSW|RTE|ECU-Abstraction), [\w -]+? layer\)", "functional_flow": r"\bfunctional flow\b"},
    ),
    ADAPTIVE: (
        {"doc_id_706": r"Document ID 706", "release_tag": r"AUTOSAR AP R(?:1[0-9]|2[0-9])-\d{2}\b", "ara_namespace": r"\bara::(?:com|rest|core|per)\b", "fc_abbreviation": r"\bFCs?\b", "exp_series": r"AUTOSAR_EXP_\w+"},
        {"ara_full": r"AUTOSAR Runtime for Adaptive", "functional_cluster": r"Functional Clusters?", "ap_foundation": r"Adaptive Platform Foundation", "ap_services": r"Adaptive Platform Services?", "adaptive_application": r"Adaptive Applications?", "machine_manifest": r"Machine Manifest", "execution_manifest": r"Execution [Mm]anifest", "service_instance_manifest": r"Service Instance Manifest", "pse51": r"\bPSE51\b", "state_management": r"State Management", "execution_management": r"Execution Management", "communication_management": r"Communication Management", "platform_health": r"Platform Health Management"},
    ),
}
WEIGHTS = {APPLICATION: (2.0, 20.0, 2.0, 5.0), ADAPTIVE: (2.5, 8.0, 2.5, 12.0)}
LEAST = {APPLICATION: 3.0, ADAPTIVE: 4.0}
CONFIDENCE = {APPLICATION: 5.0, ADAPTIVE: 6.0}


def texts(documents: DataFrame) -> DataFrame:
    """document_name, version, sha256 and the text of all lines and table rows."""
    lines = F.array_join(F.flatten(F.transform(F.coalesce("pages", F.array()), lambda p: F.coalesce(p["lines"], F.array().cast("array<string>")))), "\n")
    rows = F.array_join(F.flatten(F.transform(F.coalesce("tables", F.array()), lambda t: F.transform(F.coalesce(t["rows"], F.array().cast("array<array<string>>")), lambda r: F.array_join(r, " | ", "")))), "\n")
    return documents.select("document_name", "version", "sha256", F.concat_ws("\n", lines, rows).alias("text"))


def detect(documents: DataFrame, key: str = "sha256", text: str = "text") -> DataFrame:
    """key, profile, score, n_signals, confidence: the profile of the best score (the later name on ties), if the score and
    two signals at least bear it, else the generic one."""
    found = ingest.classify(documents, SIGNALS, WEIGHTS, LEAST, key, text)
    by = F.when(F.col("profile") == APPLICATION, CONFIDENCE[APPLICATION]).when(F.col("profile") == ADAPTIVE, CONFIDENCE[ADAPTIVE])
    return found.withColumn("confidence", F.coalesce(F.least(F.lit(1.0), F.col("score") / by), F.lit(0.0)))
