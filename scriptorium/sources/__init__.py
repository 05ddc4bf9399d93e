"""Scans, selections, landed payloads, sinks and manifests."""
