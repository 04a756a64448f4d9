"""Engine settings, presets and the lookup tables that queries share."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class LshConfig:
    tables: int = 20
    bits: int = 12
    dimension: int = 384
    seed: int = 42
    probes: int = 3
    scored_probes: bool = False
    orthogonal: bool = False
    bucket_rows: int = 1000
    overflow_buckets: int = 3


@dataclass(frozen=True)
class EmbeddingConfig:
    model: str = "tfidf"  # or "mock"
    idf: str = "batch"  # or "online", which needs an ingest order
    ngrams: int = 2
    vocabulary: int = 50_000
    min_df: int = 1
    max_df_ratio: float = 1.0


@dataclass(frozen=True)
class ParserConfig:
    min_tokens: int = 10
    min_chars: int = 20
    default_language: str = "typescript"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**", "**/vendor/**")


@dataclass(frozen=True)
class EngineConfig:
    lsh: LshConfig = field(default_factory=LshConfig)
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    parser: ParserConfig = field(default_factory=ParserConfig)
    min_similarity: float = 0.8
    max_results: int = 100
    summary_similarity: float = 0.85

    def merged(self, changes: dict) -> EngineConfig:
        """This configuration with (nested) changes; unknown names raise."""
        return _merged(self, changes)

    @staticmethod
    def load(path: str) -> EngineConfig:
        """Defaults merged with a JSON or TOML file on the driver."""
        raw = Path(path).read_bytes()
        return EngineConfig().merged(tomllib.loads(raw.decode()) if path.endswith(".toml") else json.loads(raw))


def _merged(base, changes: dict):
    known = {f.name for f in fields(base)}
    out = {}
    for name, value in changes.items():
        if name not in known:
            raise KeyError(f"unknown setting {name}")
        now = getattr(base, name)
        out[name] = _merged(now, value) if is_dataclass(now) else tuple(value) if isinstance(now, tuple) else value
    return replace(base, **out)


PRESETS = {
    "fast": EngineConfig(lsh=LshConfig(tables=10, bits=8), min_similarity=0.85),
    "balanced": EngineConfig(min_similarity=0.85),
    "accurate": EngineConfig(lsh=LshConfig(tables=30, bits=16), min_similarity=0.90),
}

#: Similarity from which a pair counts as each type; below the last it is type-4.
CLONE_BANDS = ((0.99, "type-1"), (0.95, "type-2"), (0.85, "type-3"))
CLONE_NAMES = {"type-1": "Exact", "type-2": "Renamed", "type-3": "Modified", "type-4": "Semantic"}

#: File extensions of each language.
LANGUAGE_EXTENSIONS = {
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "python": (".py", ".pyi", ".pyw"),
    "java": (".java",),
    "csharp": (".cs",),
    "go": (".go",),
    "rust": (".rs",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"),
    "ruby": (".rb",),
    "php": (".php", ".phtml"),
    "swift": (".swift",),
    "kotlin": (".kt", ".kts"),
    "scala": (".scala",),
    "haskell": (".hs",),
    "elixir": (".ex", ".exs"),
    "clojure": (".clj", ".cljs"),
    "lua": (".lua",),
    "perl": (".pl", ".pm"),
    "r": (".r", ".R"),
    "julia": (".jl",),
    "dart": (".dart",),
    "vue": (".vue",),
    "svelte": (".svelte",),
    "sql": (".sql",),
}
EXTENSION_LANGUAGE = {ext: lang for lang, exts in LANGUAGE_EXTENSIONS.items() for ext in exts}
