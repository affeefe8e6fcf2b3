"""Intermediate tables of this subpackage; see ``tessera.store``."""

from tessera.store import checkpoint_root, keep, tasks

__all__ = ["checkpoint_root", "keep", "tasks"]
