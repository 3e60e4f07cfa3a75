"""Settings of the plans, checked when they're made."""

from __future__ import annotations

from dataclasses import dataclass


def _between(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}, not {value}")


def _one_of(name: str, value, *allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(str, allowed))}, not {value}")


@dataclass(frozen=True)
class Ledger:
    """Chunking, similarity and retrieval of the claim ledger."""

    chunk_size: int = 3500
    chunk_overlap: int = 250
    least_page_text: int = 40
    same_fact: float = 0.82
    retrieval: float = 0.62
    top_k: int = 16
    component: int = 60
    embed_batch: int = 32

    def __post_init__(self):
        _between("chunk_size", self.chunk_size, 500, 100_000)
        _between("chunk_overlap", self.chunk_overlap, 0, self.chunk_size - 1)
        for name in ("same_fact", "retrieval"):
            _between(name, getattr(self, name), 0, 1)
        for name in ("top_k", "component", "embed_batch"):
            _between(name, getattr(self, name), 1, 10_000)


@dataclass(frozen=True)
class Cleanup:
    """Corrections of recognised text."""

    dpi: int = 300
    context_chars: int = 500
    max_corrections: int = 64
    use_model: bool = True
    confidence: float = 0.5
    max_pages: int = 2000
    max_pixels: int = 100_000_000
    timeout: float = 600
    batch: int = 4
    layout: str = "0"
    direction: str = "lr"

    def __post_init__(self):
        for name in ("max_pages", "max_pixels", "timeout", "batch"):
            _between(name, getattr(self, name), 1e-9, float("inf"))
        _between("confidence", self.confidence, 0, 1)
        _one_of("layout", self.layout, "0", "1", "1.5", "2")
        _one_of("direction", self.direction, "lr", "rl")
        _between("dpi", self.dpi, 72, 1200)
        _between("context_chars", self.context_chars, 20, 10_000)
        _between("max_corrections", self.max_corrections, 0, 100_000)


@dataclass(frozen=True)
class Translation:
    """Segments, quality and retries of translations."""

    max_source_tokens: int = 256
    batch: int = 8
    threshold: float = 0.72
    max_retries: int = 2
    beam: int = 4
    context: int = 2
    tone: str = "neutral"

    def __post_init__(self):
        _between("max_source_tokens", self.max_source_tokens, 8, 4096)
        _between("batch", self.batch, 1, 1024)
        _between("threshold", self.threshold, 0, 1)
        _between("max_retries", self.max_retries, 0, 20)

    def beams(self) -> list[int | None]:
        """The beam of each attempt: the engine's own at first, then a wider one."""
        return [None, *[max(self.beam + 2, 2 * self.beam)] * self.max_retries]
