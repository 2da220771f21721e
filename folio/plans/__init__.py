"""Whole flows: interpret pages, accept the valid prefix, publish, render, write."""
