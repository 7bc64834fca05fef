"""What the operators share with the rest of the library: spools in the shared folder, names, joins on hot keys."""

from __future__ import annotations

from ..scratch import discard, prepare, quoted, spool, spread_join, transient, unused, work_dir, write

__all__ = ["discard", "prepare", "quoted", "spool", "spread_join", "transient", "unused", "work_dir", "write"]
