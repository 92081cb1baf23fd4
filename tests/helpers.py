"""What test modules share. It is no conftest: two folders with a conftest each would hide one another's names."""

SF_SMALL = "/root/testdata/sf0.001"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme, to list a local folder."""
    return path[len("file:"):] if path.startswith("file:") else path


def rows(df, *cols):
    """Sorted list of tuples (of ``cols`` or all columns) for comparisons."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()),
                  key=lambda t: tuple((x is None, 0 if x is None else x) for x in t))
