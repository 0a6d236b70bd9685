"""Training-data operators: filters, duplicate detection, decontamination, packing."""
