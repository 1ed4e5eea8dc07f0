"""Lexicographic XML analytics as Spark jobs: shred, discover, select, map, number, label and assemble dictionaries."""
