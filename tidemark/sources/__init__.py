"""Readers and writers of series, texts and codec artefacts."""
