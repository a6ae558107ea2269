"""Training-data operators: token files, scoring, packing, extraction,
decontamination, quality, near-duplicates, toxicity and licences.

Nothing outside this subpackage imports it.
"""
