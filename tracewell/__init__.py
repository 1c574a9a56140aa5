"""Tracewell: provenance-aware document analytics expressed as Spark DataFrame plans."""
