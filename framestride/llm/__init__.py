"""Training-data operators: dedup, tokenising, packing, archives, language and licence scans."""
