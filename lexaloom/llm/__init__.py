"""Training-data operators: privacy, deduplication, decontamination, language, licenses, packing and archives."""
