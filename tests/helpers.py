"""Shared by the test modules."""


def rows(df, *columns):
    """Rows as sorted tuples, optionally of some columns."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: [(v is None, str(v)) for v in r])
