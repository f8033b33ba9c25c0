"""Helpers of the library's tests. In a module of its own: every test folder has a ``conftest``, and which one
``import conftest`` finds depends on the order of collection."""

SMOKE_DIR = "/root/testdata/sf0.001"


def rows(df, *cols):
    """Sorted list of tuples of the given columns."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
