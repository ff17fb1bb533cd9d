"""Importing this package registers every query."""
import importlib

from .registry import REGISTRY, Query

for _m in ("section_quality", "section_runs", "blocks_and_sampling", "patches_and_labels", "similarity", "annotation", "registry_and_fleet", "pixels", "label_runs", "volumes", "serial", "qc_run", "files", "streams"):
    importlib.import_module(f"{__name__}.{_m}")

__all__ = ["REGISTRY", "Query"]
