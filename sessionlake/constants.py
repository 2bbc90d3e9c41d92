"""Names that results carry, and errors."""

from __future__ import annotations

#: The provenance columns of every scanned row.
SESSION_PATH = "_nwb_path"
TABLE_PATH = "_table_path"
TABLE_INDEX = "_table_index"
UNIT_INDEX = "_units_table_index"
INTERVAL_INDEX = "_intervals_table_index"
PROVENANCE = (SESSION_PATH, TABLE_PATH, TABLE_INDEX)

#: Short names of tables.
SHORTCUTS = {
    "trials": "intervals/trials",
    "epochs": "intervals/epochs",
    "electrodes": "general/extracellular_ephys/electrodes",
    "optophysiology": "general/optophysiology",
    "session": "general",
}


class ColumnError(KeyError):
    """A column that isn't there."""


class InternalPathError(KeyError):
    """A path that a session doesn't have, or that holds something else."""


def normalise(path: str) -> str:
    """The internal path without its leading slash; short names are expanded."""
    path = path.removeprefix("/")
    return SHORTCUTS.get(path, path) or "/"
