"""Training-data operators (mixing, near-dedup, chat formatting, extraction, filters,
fingerprints, classifiers, PII, tokenisation). Nothing outside this folder imports it."""
