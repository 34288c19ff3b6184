"""Part of murmuration."""
