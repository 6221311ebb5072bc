"""Readers and writers of workspaces, metadata and gene sets."""
