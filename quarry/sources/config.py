"""Settings from the environment, and discovery of the input."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


def int_env(name: str, default: int) -> int:
    """The variable as a number; the default where it is unset, empty or no number."""
    try:
        return int(os.environ.get(name) or default)
    except ValueError:
        return default


@dataclass(frozen=True)
class Settings:
    """RAG_STORAGE_DIR, RAG_REPORTS_DIR, RAG_CHAT_MODEL, RAG_EMBEDDING_MODEL, RAG_TOP_K,
    RAG_OCR_LANG, RAG_OCR_DPI, RAG_EMBEDDING_PROVIDER, RAG_MAX_OUTPUT_TOKENS."""

    storage_dir: str = "storage"
    reports_dir: str = "reports"
    chat_model: str = "gpt-5-mini"
    embedding_model: str = "text-embedding-3-large"
    top_k: int = 5
    ocr_lang: str = "vie+eng"
    ocr_dpi: int = 220
    embedding_provider: str = "openai"
    max_output_tokens: int = 1200

    @classmethod
    def from_env(cls) -> Settings:
        made = {}
        for name, field in cls.__dataclass_fields__.items():
            key = f"RAG_{name.upper()}"
            made[name] = int_env(key, field.default) if isinstance(field.default, int) else os.environ.get(key, field.default)
        return cls(**made)

    @property
    def ocr_dir(self) -> str:
        return f"{self.storage_dir}/ocr"

    @property
    def pages_path(self) -> str:
        return f"{self.ocr_dir}/pages"

    @property
    def index_path(self) -> str:
        return f"{self.storage_dir}/index"


def find_default_pdf(base: str | Path = ".") -> Path:
    """The one PDF file in ``base``."""
    found = sorted(Path(base).glob("*.pdf"))
    if not found:
        raise FileNotFoundError(f"no PDF in {base}; name one")
    if len(found) > 1:
        raise FileExistsError(f"several PDFs in {base}: {', '.join(p.name for p in found)}; name one")
    return found[0]
