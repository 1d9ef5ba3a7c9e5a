"""All queries of the memory operators with their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("operators.index", "operators.facts", "operators.log", "operators.limits", "operators.vectors", "operators.topics", "operators.texts", "operators.sessions", "operators.retrieve", "operators.recall", "operators.cleaning", "operators.linkage", "operators.packs", "operators.merging", "operators.phrases", "operators.learner", "operators.statements", "sources.transcripts", "sources.intake", "streaming.events", "streaming.stateful")

QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    _module = import_module(f"recollect.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
