"""Operators over pages: running state, rules, publication, rendering, storage, inference decisions."""
