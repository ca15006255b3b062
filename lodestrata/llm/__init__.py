"""Training-data operators: token counts, toxicity, deduplication, PII, decontamination, BPE, packing, quality, search, runs.

Nothing outside this package imports it.
"""
