"""Training-data pipeline operators: filtering, deduplication, packing, archives and search over large document tables."""
