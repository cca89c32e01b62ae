"""Training-data operators: quality, search, near-duplicates, packing, token files, mixing, toxicity, HTML, licences."""
