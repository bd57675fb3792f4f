"""Training-data operators: fingerprints, deduplication, filtering, decontamination, mixing."""
