"""The tables between steps, as the rest of the library keeps them."""

from __future__ import annotations

from ..sources.scratch import Scratch

__all__ = ["Scratch"]
