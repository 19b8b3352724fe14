"""Checks between a document's fields that a schema of single fields can't state."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

from . import canonical
from .calibration import Invalid


def _unique(values: Iterable, what: str) -> None:
    values = list(values)
    if len(set(values)) < len(values):
        raise Invalid(f"{what} must be unique")


def _snapshot(d: dict) -> None:
    sources, outputs = [s["source_id"] for s in d["sources"]], [t["output"]["artifact_id"] for t in d["transformations"]]
    _unique([*sources, *outputs], "artifact ids")
    _unique([t["transformation_id"] for t in d["transformations"]], "transformation ids")
    _unique([v["view_id"] for v in d["views"]], "view ids")
    used = {a for t in d["transformations"] for a in t["inputs"]} | {a for v in d["views"] for a in v["input_artifact_ids"]}
    if missing := used - {*sources, *outputs}:
        raise Invalid(f"unknown inputs: {', '.join(sorted(missing))}")


def _experiment(d: dict) -> None:
    replicas = d["validation"]
    if not replicas["quorum"] <= replicas["initial_replicas"] <= replicas["max_replicas"]:
        raise Invalid("a quorum needs so many initial replicas, and these at most so many")
    _unique([m["metric_id"] for m in d["metrics"]], "metric ids")
    _unique([c["control_id"] for c in d["controls"]], "control ids")
    if d["stopping_rule"]["max_work_units"] < -(-d["search"]["candidate_count"] // d["search"]["shard_size"]):
        raise Invalid("the units can't cover the search space")


def _unit(d: dict) -> None:
    part = d["partition"]
    if (part["role"] == "control") != (part["control_id"] is not None):
        raise Invalid("a control has a control id, and nothing else has one")
    for name in ("artifact_id", "logical_name"):
        _unique([x[name] for x in d["inputs"]], f"inputs' {name}")


def _envelope(d: dict) -> None:
    if datetime.fromisoformat(d["finished_at"]) < datetime.fromisoformat(d["started_at"]):
        raise Invalid("a result can't be finished before it is started")


def _validation(d: dict) -> None:
    digests = d["result_output_digests"]
    if len(digests) != len(d["result_ids"]) or d["quorum"] > len(digests):
        raise Invalid("each result has a digest, and a quorum is at most all of them")
    if d["decision"] == "canonical" and digests.count(d["canonical_output_digest"]) < d["quorum"]:
        raise Invalid("the canonical output lacks its quorum")


#: The registry of kinds. Another one is registered by adding it here.
KINDS: dict[str, Callable[[dict], None]] = {"corpus-snapshot": _snapshot, "experiment": _experiment, "work-unit": _unit, "result-envelope": _envelope, "validation-record": _validation}


def checked(kind: str, document: dict) -> str:
    """The identity of a document that passes its kind's checks."""
    if kind not in KINDS:
        raise Invalid(f"unknown kind {kind}")
    KINDS[kind](document)
    return canonical.identity(document)


def read(kind: str, text: str) -> dict:
    """A document from strict JSON, checked."""
    document = canonical.loads(text)
    checked(kind, document)
    return document


def bundle(documents: dict[str, tuple[str, dict]], references: Iterable[tuple[str, str, str]]) -> dict[str, str]:
    """The identities of a bundle's documents (kind, document) by name, if every reference (name,
    field, name referred to) holds the identity of what it refers to."""
    found = {name: checked(kind, document) for name, (kind, document) in documents.items()}
    for name, field, other in references:
        if other not in found or documents[name][1].get(field) != found[other]:
            raise Invalid(f"{name}'s {field} isn't the identity of {other}")
    return found
