"""Operations of a training-data pipeline: filters, tokenizers, near-duplicates, search."""
