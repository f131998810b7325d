"""Where the public vocabulary files are."""

from __future__ import annotations


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the package that names it is installed on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)
