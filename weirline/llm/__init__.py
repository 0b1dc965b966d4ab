"""Training-data operators at corpus scale: secrets, near-duplicates, decontamination,
quality rules, sharding, token counts, language, line dedup, personal data, subword pieces."""
