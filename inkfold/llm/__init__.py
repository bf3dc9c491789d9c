"""Operations for large text corpora: scoring, deduplication, decontamination, formatting, token files, packing."""
