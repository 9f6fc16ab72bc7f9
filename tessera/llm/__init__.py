"""Training-data operators: tokens, archives, near-duplicates, filters, scores and scans."""
