"""Training-data pipeline operators: tokenising, filtering, deduplication, scanning, sharding."""
