"""Training-data operators: packing, filters, fingerprints, dedup, chat, BPE, PII, quality."""
