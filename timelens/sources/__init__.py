"""Readers: sidecar files, URIs, vendor logs, media metadata, traces."""
