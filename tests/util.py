"""Helpers for comparing small results."""


def rows(df, *columns):
    """Sorted plain tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
