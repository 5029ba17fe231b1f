"""Readers: file trees, LCOV, traces, Markdown, Python structure, manifests, Git objects."""
