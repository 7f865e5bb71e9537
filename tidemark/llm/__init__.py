"""Training-data operators: fingerprints, sharding, dedup, encoding, classifiers, packing and scoring."""
