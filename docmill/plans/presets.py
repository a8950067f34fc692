"""Retrieval plans: what a query's kind and the stage of its search decide before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Results a query of each kind takes, and the surest floor of each stage.
TOP_K = {"single_doc": 4, "follow_up": 6, "comparison": 6}
STAGES = ("strict", "reduced", "relaxed")
RETRY_TOP_K = 8


@dataclass(frozen=True)
class Plan:
    query_type: str = "single_doc"
    stage: str = "strict"
    top_k: int = 4
    backend: str = "dense"
    channels: tuple[str, ...] = ("dense",)
    rrf_k: int = 60
    rerank: bool = True
    metadata_first: bool = True
    hierarchical: bool = False
    min_per_target: int = 1
    targets: tuple[str, ...] = field(default_factory=tuple)


# The named settings of a search.
PRESETS = {
    "naive_baseline": Plan(rerank=False, metadata_first=False),
    "full": Plan(backend="hybrid", channels=("dense", "bm25")),
    "hybrid_bm25": Plan(backend="hybrid", channels=("dense", "bm25")),
    "no_rerank": Plan(rerank=False),
    "hierarchical": Plan(hierarchical=True),
    "m3": Plan(backend="m3", channels=("dense", "m3_sparse", "m3_colbert")),
}


def make_plan(preset: str, query_type: str, targets: tuple[str, ...] = (), attempt: int = 1, stage: str = "strict") -> Plan:
    """The plan of one attempt: comparisons take 3 a target plus 2 within [6, 12], later attempts 8 at least."""
    top_k = TOP_K[query_type]
    if query_type == "comparison" and targets:
        top_k = max(6, min(12, 3 * len(targets) + 2))
    if attempt >= 2:
        top_k = max(top_k, RETRY_TOP_K)
    return replace(PRESETS[preset], query_type=query_type, targets=targets, top_k=top_k, stage=stage)


def stages(strict: frozenset[str], reduced: frozenset[str], metadata_first: bool = True, retry: bool = True) -> tuple[str, ...]:
    """Stages to try in order; reduced only where it finds other documents than strict."""
    if not metadata_first or not (strict or reduced):
        return ("relaxed",)
    first = ["strict"] if strict else []
    if reduced and reduced != strict:
        first.append("reduced")
    return tuple([*first, "relaxed"]) if retry else tuple(first[:1])
