"""Training-data operators: filtering, matching, mixing and packing of document tables."""
