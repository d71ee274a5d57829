"""Readers and writers: tables, CSV, edge parts with manifests."""
