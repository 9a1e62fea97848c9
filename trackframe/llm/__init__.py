"""Training-data operators (secret scans, dedup, decontamination, scoring, mixing, search).

Nothing outside this subpackage imports it.
"""
