"""Readers and writers: files and parsers, snapshots, and the versioned chunk store."""
