"""Training-data operators: fingerprints, near duplicates, archives, byte-pair
encoding, language-model scores, exact-substring removal, toxicity, packing,
quality selection, embedding near duplicates, source mixing, centroid clustering and
whitening.

Each module holds one operator with a general interface; ``queries`` wraps them
as the registered ``opN_<name>`` queries.
"""
