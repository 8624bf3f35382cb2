"""Named queries; importing them fills the catalogue."""

from __future__ import annotations

from importlib import import_module

for _name in ("panel", "scores", "pairs", "items", "vectors_and_text", "fitted", "files", "questionnaires", "readying", "readers", "heads", "traits", "trees", "resuming"):
    import_module(f"surveyloom.plans.{_name}")
