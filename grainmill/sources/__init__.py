"""Readers and writers: JSON lines, JSON documents, digests, the vector table and the stage store."""
