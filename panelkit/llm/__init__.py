"""Training-data operators: language ID, tokenizing, scoring, near-duplicates, masking, decontamination."""
