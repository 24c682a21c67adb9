"""Training-data pipeline operators: tokens, decontamination, media, dedup, language, HTML, PII, mixing, quality."""
