"""Training-data operators: chat rendering, deduplication, scanning, filtering, encoding and packing of documents."""
