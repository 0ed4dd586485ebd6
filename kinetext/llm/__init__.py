"""Training-data operators (packing, deduplication, decontamination, ...), each in a module of its own."""
