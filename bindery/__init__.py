"""Bindery: packs document corpora into framed text bundles and back, on Spark."""

from bindery.config import PackConfig

__all__ = ["PackConfig"]
