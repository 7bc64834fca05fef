"""Connected components, from the library's own operator."""

from __future__ import annotations

from ..operators.graph import components

__all__ = ["components"]
