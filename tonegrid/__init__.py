"""Spark jobs over tables of music tracks: union, enrichment, features, maps, analytics and sets."""
