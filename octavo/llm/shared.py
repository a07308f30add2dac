"""Where operators keep what several jobs read, and checks of a size before a broadcast: those of the engine."""

from pyspark.sql import DataFrame

from octavo.storage import BROADCAST_ROWS, cleared, give_back, keep, new_path, remove, scratch, shared_dir, sized

__all__ = ["BROADCAST_ROWS", "cleared", "give_back", "keep", "new_path", "remove", "scratch", "shared_dir", "sized", "unused"]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as long as a column of the table is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
