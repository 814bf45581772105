"""Connected components of fingerprints: the library's own."""

from __future__ import annotations

from loomspark.operators.components import connected_components

__all__ = ["connected_components"]
