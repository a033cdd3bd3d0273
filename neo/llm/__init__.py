"""Training-data operators: deduplication, filtering, scanning, decontamination and packing."""
