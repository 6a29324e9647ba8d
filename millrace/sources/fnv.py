"""FNV-1a of byte strings."""

from __future__ import annotations


def fnv1a64(data: bytes) -> int:
    h = 14695981039346656037
    for byte in data:
        h = (h ^ byte) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h
