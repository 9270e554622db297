"""Training-data operators: cleaning, deduplication, decontamination, packing.

Nothing outside this subpackage imports it.
"""
