"""Training-data operators: line, exact, near and suffix-array deduplication,
archives, packing, fingerprints, toxicity, licences and source mixing.

Nothing outside this folder imports it; ``queries`` and ``sql`` register it.
"""
