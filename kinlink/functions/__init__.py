"""Scalar building blocks: text folding, transliteration, string scorers."""
