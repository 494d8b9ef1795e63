"""Whole runs: pack, unpack, and the registered queries."""
