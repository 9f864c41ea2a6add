"""Operators for training data: consistent text, similar vectors, token ids, mixtures and languages.

Nothing outside this subpackage imports it."""
