"""Embedding models and the backfill of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.vectors import plan_storage

DISTANCES, MODALITIES = ("cosine", "l2", "ip"), ("text", "image")


@dataclass(frozen=True)
class Model:
    slug: str
    width: int
    distance: str = "cosine"
    modality: str = "text"
    remote: bool = False
    shortens: bool = False
    default: bool = False

    def __post_init__(self):
        if self.distance not in DISTANCES:
            raise ValueError(f"unknown distance {self.distance!r}; choose one of {', '.join(DISTANCES)}")
        if self.modality not in MODALITIES:
            raise ValueError(f"unknown modality {self.modality!r}; choose one of {', '.join(MODALITIES)}")

    @property
    def stored_width(self) -> int:
        return plan_storage(self.width, self.shortens)[0]


@dataclass
class Registry:
    """Models by slug; the first becomes the default."""

    models: dict[str, Model] = field(default_factory=dict)

    def register(self, model: Model) -> Model:
        old = self.models.get(model.slug)
        if old and (old.width, old.distance) != (model.width, model.distance):
            raise ValueError(f"model {model.slug!r} exists with width {old.width} and distance {old.distance}")
        if not old:
            self.models[model.slug] = replace(model, default=False)
        if model.default or len(self.models) == 1:
            self.set_default(model.slug)
        return self.models[model.slug]

    def set_default(self, slug: str) -> None:
        self.models[slug]  # must exist
        self.models = {s: replace(m, default=s == slug) for s, m in self.models.items()}

    def drop(self, slug: str) -> None:
        if self.models.pop(slug).default and self.models:
            self.set_default(min(self.models))

    def default(self) -> Model | None:
        return next((m for m in self.models.values() if m.default), None)


def pending(chunks: DataFrame, vectors: DataFrame, model: Model) -> DataFrame:
    """Chunks a model has no vector for. Pictures are left to image models; a remote model never gets communication."""
    rows = chunks.where(F.coalesce(F.col("chunker"), F.lit("")) == "image" if model.modality == "image" else F.coalesce(F.col("chunker"), F.lit("")) != "image")
    if model.remote:
        rows = rows.where(F.col("corpus_class") != "communication")
    return rows.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def backfill(todo: DataFrame, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], model: Model, batch: int = 64) -> DataFrame:
    """``chunk_id, embedding`` of pending chunks; a batch with vectors of another width fails the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for s in range(0, len(rows), batch):
                part = rows.iloc[s : s + batch]
                found = [list(map(float, v)) for v in embed(part["text"].tolist())]
                if len(found) != len(part) or any(len(v) != model.width for v in found):
                    raise ValueError(f"the embedder must give one vector of width {model.width} for each text")
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "embedding": found})

    return todo.select("chunk_id", "text").mapInPandas(run, "chunk_id long, embedding array<float>")


def backfill_all(chunks: DataFrame, vectors: Callable[[], DataFrame], write: Callable[[DataFrame], None], embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], model: Model, rows: int = 100_000, tell: Callable[[int], None] = lambda n: None) -> int:
    """Embeds what is pending, some rows at a time, until nothing is; returns how many rounds wrote vectors.

    ``vectors`` reads the stored table anew, ``write`` adds to it. The first round that fails ends it with the error;
    what earlier rounds wrote stays, so a second run goes on from there. A round that adds nothing ends it too.
    """
    rounds, left = 0, None
    while True:
        todo = pending(chunks, vectors(), model)
        now = todo.count()
        tell(now)
        if not now or now == left:
            return rounds
        left = now
        write(backfill(todo.orderBy("chunk_id").limit(rows), embed, model))
        rounds += 1


def upsert(old: DataFrame, new: DataFrame, replace_old: bool = True) -> DataFrame:
    """Vectors by chunk: new ones replace old ones, or only fill gaps."""
    if replace_old:
        return old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)
    return old.unionByName(new.join(old.select("chunk_id"), "chunk_id", "left_anti"))
