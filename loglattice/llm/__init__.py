"""Training-data operators: filtering, deduplication, mixing, packing, archiving, redaction."""
