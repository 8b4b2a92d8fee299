"""Named operators of each stage, and the specification of a retrieval run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signal import PREPROCESSORS as _PREPROCESSORS
from ..operators import ann, embed, fuse, knn, pool, rank, represent, segment


class Registry:
    """Operators by key. A key is registered once; an unknown one is an error that lists the known ones."""

    def __init__(self, name: str, known: dict[str, Callable] | None = None) -> None:
        self.name, self._known = name, dict(known or {})

    def register(self, key: str) -> Callable:
        def add(f: Callable) -> Callable:
            if key in self._known:
                raise KeyError(f"{self.name} {key!r} is already there")
            self._known[key] = f
            return f
        return add

    def get(self, key: str) -> Callable:
        if key not in self._known:
            raise KeyError(f"no {self.name} {key!r}; there are: {', '.join(sorted(self._known))}")
        return self._known[key]

    def keys(self) -> list[str]:
        return sorted(self._known)

    def __contains__(self, key: str) -> bool:
        return key in self._known

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())


def _flat(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    return knn.knn(queries, corpus, k, metric)


def _lists(corpus: DataFrame, nlist: int | None) -> int:
    size = corpus.agg(F.count("*"), F.max(F.size("embedding"))).first()
    return nlist or ann.list_count(int(size[0]), int(size[1] or 1))


def _ivf(queries: DataFrame, corpus: DataFrame, k: int, nlist: int | None = None, nprobe: int | None = None) -> DataFrame:
    lists = _lists(corpus, nlist)
    return ann.ivf(queries, corpus, ann.fitted_centres(corpus, lists), k, min(nprobe or ann.probe_count(lists), lists))


def _graph(queries: DataFrame, corpus: DataFrame, k: int, M: int = 32, ef_construction: int = 200, ef_search: int = 64) -> DataFrame:  # noqa: N803
    """In place of a graph index, whose links can't be kept apart on executors: inverted lists. As many are probed as hold ``ef_search`` times
    ``M`` rows, and no less than reach the recall that is tested; ``ef_construction`` has no meaning here."""
    lists = _lists(corpus, None)
    rows = corpus.count()
    return _ivf(queries, corpus, k, lists, max(ann.probe_count(lists), -(-ef_search * M * lists // max(1, rows))))


def _served(queries: DataFrame, corpus: DataFrame, k: int, num_candidates: int = 100, metric: str = "cosine") -> DataFrame:
    """What a search server returns: the best of ``num_candidates`` exact hits, with scores (1 + cosine) / 2 mapped back."""
    return knn.knn(queries, corpus, max(k, num_candidates), metric).where(F.col("rank") <= k)


PREPROCESSORS = Registry("preprocessor", _PREPROCESSORS)
SEGMENTERS = Registry("segmenter", segment.SEGMENTERS)
AGGREGATORS = Registry("aggregator", pool.AGGREGATORS)
REPRESENTATIONS = Registry("representation", represent.REPRESENTATIONS)
INDEXES = Registry("index", {"flat": _flat, "ivf": _ivf, "ivfpq": ann.ivfpq, "hnsw": _graph, "es": _served})
RANKERS = Registry("ranker", rank.RANKERS)
FUSIONS = Registry("fusion", fuse.FUSIONS)
EMBEDDERS = Registry("embedder", embed.EMBEDDERS)


@dataclass(frozen=True)
class Stage:
    type: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class RetrievalSpec:
    """What a run is made of; every stage is a key and parameters."""

    representation: Stage = Stage("segment")
    index: Stage = Stage("flat")
    fusion: Stage = Stage("late")
    ranking: Stage = Stage("rrf")
    top_k: int = 10

    @classmethod
    def of(cls, config: dict[str, Any]) -> RetrievalSpec:
        """From a mapping, such as a YAML file's; unknown keys are errors."""
        stages = {}
        for key, value in config.items():
            if key == "top_k":
                stages[key] = int(value)
            elif key in ("representation", "index", "fusion", "ranking"):
                stages[key] = Stage(value["type"], dict(value.get("params") or {})) if isinstance(value, dict) else Stage(str(value))
            else:
                raise KeyError(f"unknown setting {key!r}")
        return cls(**stages)

    @classmethod
    def load(cls, path: str | Path) -> RetrievalSpec:
        import yaml

        return cls.of(yaml.safe_load(Path(path).read_text()) or {})


def aggregator(key: str | Callable, params: dict[str, Any] | None = None) -> Callable[..., DataFrame]:
    """A pooling by key, with its parameters."""
    found = AGGREGATORS.get(key) if isinstance(key, str) else key
    return partial(found, **(params or {}))


def pooled_params(stage: Stage, default: Stage | None = None) -> dict[str, Any]:
    """A stage's parameters, with the pooling that it names (``aggregator`` and ``aggregator_params``) or the default one."""
    params = dict(stage.params)
    key, own = params.pop("aggregator", None), params.pop("aggregator_params", {})
    if key is None and default is not None:
        key, own = default.type, default.params
    if key is not None:
        params["aggregator"] = aggregator(key, own)
    return params


def documents(segs: DataFrame, stage: Stage, default: Stage | None = None) -> DataFrame:
    """Documents of segments; only the representations that pool take an aggregator."""
    params = pooled_params(stage, default)
    if stage.type not in ("audio", "species"):
        params.pop("aggregator", None)
    return REPRESENTATIONS.get(stage.type)(segs, **params)


def search(queries: DataFrame, corpus: DataFrame, index: Stage, fusion: Stage, ranking: Stage, top_k: int, labels: DataFrame | None = None,
        default: Stage | None = None) -> DataFrame:
    """Ranked labels of each query; corpus: doc_id, label, embedding."""
    params = pooled_params(fusion, default) if fusion.type == "early" else dict(fusion.params)
    fused = FUSIONS.get(fusion.type)(queries, **params)
    hits = INDEXES.get(index.type)(fused, corpus, knn.candidates(top_k, corpus.count()), **index.params)
    ranker, own = RANKERS.get(ranking.type), dict(ranking.params)
    if ranking.type == "taxonomy_boost":
        if labels is None:
            raise ValueError("taxonomy_boost needs the labels' names")
        if "common_name_boost" in own:
            own["common_boost"] = own.pop("common_name_boost")
        return rank.take_top_k(ranker(hits, labels, **own), top_k)
    return rank.take_top_k(ranker(hits, **own), top_k)


def retrieve(spec: RetrievalSpec, segs: DataFrame, queries: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """segs: item_id, seg_idx, label, embedding; queries: query_id, q_seg, embedding. Returns ranked labels for each query."""
    docs = documents(segs, spec.representation)
    corpus = docs.select("doc_id", "label", docs["vector"].alias("embedding"))
    return search(queries, corpus, spec.index, spec.fusion, spec.ranking, spec.top_k, labels)
