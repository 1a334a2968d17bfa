"""Readers: batch files, JSON payloads, snapshots, and digests of landed files."""
