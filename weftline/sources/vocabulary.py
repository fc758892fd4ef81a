"""Vocabularies as files: one that other libraries read, and what it was made from."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from .. import storage
from ..operators.subword import SPECIALS, Lattice, Merges, check_specials

#: Names in an artifact's folder (fixed values).
FILES = ("tokenizer.json", "training_metadata.json")


def _model(vocabulary: Merges | Lattice) -> tuple[str, dict[str, Any]]:
    added = [{"id": i, "content": s, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, s in enumerate(SPECIALS)]
    whole = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": {"type": "NFKC"}, "post_processor": None}
    if isinstance(vocabulary, Merges):
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True}
        model = {"type": "BPE", "dropout": None, "unk_token": "<unk>", "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": vocabulary.ids, "merges": [list(p) for p in vocabulary.ranks]}
        return "bpe", whole | {"pre_tokenizer": byte_level, "decoder": byte_level, "model": model}
    model = {"type": "Unigram", "unk_id": SPECIALS.index("<unk>"), "vocab": [list(p) for p in vocabulary.pieces], "byte_fallback": False}
    return "unigram", whole | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "decoder": None, "model": model}


def save(spark: SparkSession, folder: str, vocabulary: Merges | Lattice, identity: str, settings: dict[str, Any] | None = None) -> dict[str, Any]:
    """Write a vocabulary beside its place, then give it its name; one that is there and complete is told and left, anything else in the way is an error."""
    there = set(storage.names(spark, folder))
    if set(FILES) <= there:
        return describe(spark, folder, identity)
    if there - {".gitkeep"}:
        raise FileExistsError(f"{folder} has {sorted(there)}")
    kind, whole = _model(vocabulary)
    check_specials(vocabulary.pieces[: len(SPECIALS)] if isinstance(vocabulary, Merges) else [p for p, _ in vocabulary.pieces[: len(SPECIALS)]])
    about = {"kind": kind, "identity_sha256": identity, "vocab_size": len(vocabulary.pieces), "settings": settings or {}}
    staged = f"{folder}.incomplete"
    storage.remove(spark, staged)
    storage.write_bytes(spark, f"{staged}/{FILES[0]}", json.dumps(whole, ensure_ascii=False).encode())
    storage.write_bytes(spark, f"{staged}/{FILES[1]}", json.dumps(about, indent=2, ensure_ascii=False).encode())
    storage.remove(spark, folder)
    storage.rename(spark, staged, folder)
    return about


def describe(spark: SparkSession, folder: str, identity: str | None = None, kind: str | None = None) -> dict[str, Any]:
    """The metadata; an error if a file is missing, or it is of another kind or made from something else."""
    if lacks := sorted(set(FILES) - set(storage.names(spark, folder))):
        raise FileNotFoundError(f"{folder} lacks {lacks}")
    about = json.loads(storage.read_bytes(spark, f"{folder}/{FILES[1]}"))
    if (kind and about.get("kind") != kind) or (identity and about.get("identity_sha256") != identity):
        raise ValueError(f"{folder} is of kind {about.get('kind')}, identity {about.get('identity_sha256')}")
    return about


def load(spark: SparkSession, folder: str, identity: str | None = None, kind: str | None = None) -> Merges | Lattice:
    """The vocabulary, if its identity, kind and size are as they should be."""
    about = describe(spark, folder, identity, kind)
    model = json.loads(storage.read_bytes(spark, f"{folder}/{FILES[0]}"))["model"]
    if model["type"] == "BPE":
        pieces = [p for p, _ in sorted(model["vocab"].items(), key=lambda x: x[1])]
        out: Merges | Lattice = Merges(pieces, {tuple(p): i for i, p in enumerate(model["merges"])})
    else:
        out = Lattice([(p, s) for p, s in model["vocab"]])
    if len(out.pieces) != int(about["vocab_size"]):
        raise ValueError(f"{folder} has {len(out.pieces)} pieces, {about['vocab_size']} are noted")
    return out
