"""Training-data operators: language ID, LM scoring, mixing, URL filters, quality, token files, near-dedup, packing, ANN, digests."""
