"""Operations for training-data pipelines: scoring, deduplication, filtering, search and mixing of texts."""
