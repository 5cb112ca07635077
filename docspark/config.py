"""All knobs with their defaults; an environment variable of the same name in upper case overrides one, a bad value is ignored."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 700
    chunk_overlap: int = 150
    chunking_strategy: str = "recursive"
    semantic_buffer: int = 3
    semantic_percentile: float = 90.0
    semantic_max_chars: int = 1800
    hybrid_base_size: int = 300
    hybrid_similarity: float = 0.62
    hybrid_max_chars: int = 1800
    excel_rows_min: int = 3
    excel_rows_max: int = 50
    excel_sample_rows: int = 5
    excel_max_rows: int = 20_000
    top_k: int = 8
    top_n: int = 6
    top_n_sheets: int = 12
    variant_cap: int = 22
    confidence: float = 0.05
    cross_encoder_share: float = 0.6
    mmr_lambda: float = 0.7
    context_chars: int = 6000
    max_facts: int = 40
    fact_similarity: float = 0.92
    fact_chars: int = 1200
    compact_messages: int = 25
    compact_chars: int = 12_000
    keep_messages: int = 4
    prompt_messages: int = 6
    idle_seconds: int = 1800
    job_ttl_seconds: int = 3600
    report_slice_chars: int = 6000
    report_digest_chars: int = 14_000
    max_upload_mb: int = 200
    weak_page_chars: int = 20
    min_audio_bytes: int = 5000
    min_volume_db: float = -60.0

    @classmethod
    def from_env(cls) -> Settings:
        found = {}
        for f in fields(cls):
            raw = os.environ.get(f.name.upper())
            if raw is not None:
                try:
                    found[f.name] = type(f.default)(raw)
                except ValueError:
                    continue
        return cls(**found)


DEFAULTS = Settings()
