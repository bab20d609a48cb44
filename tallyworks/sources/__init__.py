"""Readers: files to bytes, bytes to records. Python opens containers; fields come from column expressions."""
