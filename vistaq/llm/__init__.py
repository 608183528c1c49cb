"""Training-data operators: mixing, scanning, deduplication, media, archives and packing."""
