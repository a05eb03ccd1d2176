"""Training-data operators: packing, toxicity, URL filters, PII, sharding,
quality rules, line dedup, decontamination, near-dedup and LM scoring."""
