"""Training-data operators: packing, filters, near-duplicates, search, output formats."""
