"""Catalog scans, nested snapshots, comparison pairs and run output."""
