"""Limits and defaults, from the environment (GLYPHSIEVE_...) or the Spark session (spark.glyphsieve....)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    # The default limits.
    max_text_length: int = 500_000
    max_upload_size_mb: float = 15
    max_unpacked_mb: float = 256
    normalize_form: str = "NFC"
    log_level: str = "INFO"

    @property
    def max_upload_bytes(self) -> int:
        return int(self.max_upload_size_mb * 1_048_576)

    @property
    def max_unpacked_bytes(self) -> int:
        """What the parts of a docx, or a stream of a pdf, may unpack to."""
        return int(self.max_unpacked_mb * 1_048_576)

    @classmethod
    def load(cls, spark=None) -> Settings:
        found = {}
        for f in fields(cls):
            value = os.environ.get(f"GLYPHSIEVE_{f.name.upper()}")
            if spark is not None:
                value = spark.conf.get(f"spark.glyphsieve.{f.name}", value)
            if value is not None:
                found[f.name] = float(value) if f.name.endswith("_mb") else type(f.default)(value)
        return cls(**found)
