"""Training-data operators: language id, fingerprints, mixing, toxicity, materialisation, near-dedup, BPE, search, LM, line dedup."""
