"""Data preparation in stages: sources checked, settings kept, plans written, task datasets made, all of it told."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from ..sources import corpus, downstream
from . import provenance as P

#: What corpora are planned for, and the modes of a run (fixed values).
PURPOSES, MODES = ("tokenizer_training", "mlm_training"), ("train", "resume", "evaluate")


def load_settings(path: str | Path, required: tuple[str, ...] = ()) -> dict[str, Any]:
    """A YAML (or JSON) file's settings; an error if it is no mapping or lacks a section."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        import json

        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: not a mapping")
    if lacks := sorted(set(required) - set(found)):
        raise ValueError(f"{path} lacks {lacks}")
    return found


def keep_settings(folder: str | Path, settings: dict[str, Any]) -> Path:
    """The settings in a file named by their hash, written once."""
    import yaml

    target = Path(folder) / f"config_{P.config_identity(settings)[:12]}.yaml"
    if not target.exists():
        P.write_text(target, yaml.safe_dump(settings, sort_keys=False, allow_unicode=True))
    return target


class Preparation:
    """One corpus's stages. settings: languages, splits, filtering, tolerance, downstream (repositories); root: raw shards by language and raw task datasets by name."""

    def __init__(self, spark: SparkSession, raw: str, processed: str, record: str | Path, settings: dict[str, Any]):
        P.validate_preparation(settings)
        self.spark, self.raw, self.processed, self.record, self.settings = spark, raw, processed, Path(record), settings
        self.languages = tuple(settings["languages"])

    def sources(self) -> dict[str, dict[str, Any]]:
        """Each language's shards, bytes and signature."""
        about = {k: corpus.read_metadata(self.spark, f"{self.raw}/{k}") for k in self.languages}
        return {k: {"signature": corpus.metadata_signature(self.spark, f"{self.raw}/{k}"), "parts": a["parts"], "text_bytes": int(a["actual_text_bytes"])} for k, a in about.items()}

    def plan_path(self, purpose: str) -> Path:
        return self.record / "plans" / purpose / "manifest.json"

    def checked_plan(self, purpose: str) -> dict[str, Any]:
        """The plan that is there, if its sources are unchanged and all their shards there."""
        plan = P.read_json(self.plan_path(purpose))
        if plan is None:
            raise FileNotFoundError(str(self.plan_path(purpose)))
        for k in plan["sources"]:
            corpus.shard_paths(self.spark, f"{self.raw}/{k}")
        return P.validate_plan(plan, lambda k: corpus.metadata_signature(self.spark, f"{self.raw}/{k}"))

    def write_plans(self, manifest: P.Manifest) -> dict[str, dict[str, Any]]:
        for purpose in PURPOSES:
            plan = P.build_plan(purpose, self.settings, self.sources())
            manifest.run(
                f"corpus_plan/{purpose}", plan["identity_sha256"], lambda p=plan, q=purpose: {"source_text_bytes": P.write_or_reuse_plan(self.plan_path(q), p)["total_text_bytes"], "languages": list(self.languages)},
                valid=lambda q=purpose: self.checked_plan(q) is not None, destination=str(self.plan_path(purpose)),
            )
        return {q: self.checked_plan(q) for q in PURPOSES}

    def task_folder(self, repository: str) -> str:
        return f"{self.processed}/downstream_tasks/{downstream.folder_name(repository)}"

    def make_tasks(self, manifest: P.Manifest) -> dict[str, dict[str, int]]:
        """Each task dataset with canonical columns, made once; one that is there and tracked by no stage is an error."""
        out = {}
        for repository in self.settings.get("downstream", []):
            folder = self.task_folder(repository)

            def work(repository: str = repository, folder: str = folder) -> dict[str, int]:
                rows = downstream.canonical(downstream.load(self.spark, f"{self.raw}/{downstream.folder_name(repository)}"), repository)
                return downstream.save(rows, folder)

            signature = P.config_identity({"repository": repository, "settings": self.settings})
            out[repository] = manifest.run(f"downstream/{repository}", signature, work, valid=lambda f=folder: bool(downstream.validate(self.spark, f)), destination=folder)
        return out

    def run(self, mode: str, tasks: bool = False) -> dict[str, Any]:
        """train and resume check the sources anew and make what is missing; evaluate checks all and writes nothing."""
        if mode not in MODES:
            raise ValueError(f"a mode is one of {MODES}")
        check = lambda: corpus.validate_sources(self.spark, self.raw, self.languages, self.settings["tolerance"])
        if mode == "evaluate":
            told = {r: downstream.validate(self.spark, self.task_folder(r)) for r in self.settings.get("downstream", [])} if tasks else {}
            return {"mode": mode, "sources": check(), "plans": {q: self.checked_plan(q) for q in PURPOSES}, "downstream": told}
        manifest = P.Manifest(self.record / "manifest.json")
        sources = manifest.run("raw_validation", P.config_identity({"settings": self.settings}), check, valid=lambda: False)
        keep_settings(self.record, self.settings)
        plans = self.write_plans(manifest)
        told = self.make_tasks(manifest) if tasks else {}
        about = {q: {k: plan[k] for k in ("identity_sha256", "purpose", "total_text_bytes")} for q, plan in plans.items()}
        P.write_json(self.record / "dataset_info.json", {"created_at_utc": P.now(), "raw_validation": sources, "plans": about, "downstream_split_rows": told})
        return {"mode": mode, "sources": sources, "plans": plans, "downstream": told}
