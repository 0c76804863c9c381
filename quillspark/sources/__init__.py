"""Readers: files as rows, each format as blocks, rendered as Markdown and as plain text."""
