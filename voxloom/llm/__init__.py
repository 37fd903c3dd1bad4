"""Operators for training data: speaker turns, nearest records, chunking, encoding, mixing, text quality."""
