"""Training-data operators: deduplication, scoring, scanning, mixing and binary output."""
