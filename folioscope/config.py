"""Settings of an engine, passed explicitly and never read at import time."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Where an engine keeps its tables and how it cuts and searches texts."""

    #: Folder of the engine's tables and stream checkpoints.
    home: str = "./data/engine"
    #: Folder that is watched for documents.
    documents: str = "./data/pdfs"
    #: How a file's place in that folder is named in the tables, and by the server: the folder may move.
    served_as: str = "./data/pdfs"
    poll_seconds: int = 10
    chunk_size: int = 300
    chunk_overlap: int = 50
    dimension: int = 1024
    #: auto, cpu or cuda: handed to embedders and answerers, which may ignore it.
    device: str = "auto"
    embedder_path: str | None = None
    answerer_path: str | None = None
    paragraph_words: int = 140
    #: Chunks from which vectors are indexed; fewer are searched exactly. 0: always exactly.
    index_from: int = 5_000
    #: Times that a failing document is tried again by the stream.
    max_attempts: int = 3

    def __post_init__(self) -> None:
        if self.chunk_size <= 0:
            raise ValueError("chunk_size must be positive")
        if self.chunk_overlap < 0:
            raise ValueError("chunk_overlap must not be negative")
        if self.dimension <= 0 or self.poll_seconds <= 0 or self.paragraph_words <= 0:
            raise ValueError("dimension, poll_seconds and paragraph_words must be positive")
        object.__setattr__(self, "device", self.device.lower())

    @classmethod
    def from_environment(cls, prefix: str = "FOLIOSCOPE_") -> Settings:
        """Settings from variables such as ``FOLIOSCOPE_CHUNK_SIZE``; what is unset keeps its default."""
        found = {f.name: os.environ[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in os.environ}
        whole = {f.name for f in fields(cls) if f.type == "int"}
        return cls(**{k: int(v) if k in whole else v for k, v in found.items()})

    def table(self, name: str) -> str:
        return f"{self.home.rstrip('/')}/{name}"
