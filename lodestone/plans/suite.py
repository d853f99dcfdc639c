"""Imports the modules that register queries."""

import importlib

MODULES = (
    "lodestone.operators.text_queries",
    "lodestone.operators.metrics_queries",
    "lodestone.operators.retrieval_queries",
    "lodestone.operators.impact_index",
    "lodestone.operators.encoder",
    "lodestone.operators.selection_queries",
    "lodestone.operators.candidates",
    "lodestone.operators.report_queries",
    "lodestone.operators.batches",
    "lodestone.sources.files",
    "lodestone.streaming.usage",
    "lodestone.streaming.writers",
)


def load() -> None:
    for name in MODULES:
        importlib.import_module(name)
