"""Operators of a training-data pipeline: licences, quality, tokens, dedup, mixing, packing.

Nothing outside this folder imports it. Each module holds one operator with a general
interface; ``queries`` derives the registered ``opN_*`` queries from them.
"""
