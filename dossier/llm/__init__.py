"""Operators for building training corpora at scale; nothing outside this subpackage imports it."""
