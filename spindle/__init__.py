"""spindle: lineage, file-inventory and time-series analytics as Spark jobs.

Every operator takes DataFrames and returns DataFrames. The only driver-side
work is the round loop of the graph walks (one small emptiness test per round).
"""

from spindle.session import build_session, checkpoint_dir, cut_lineage

__all__ = ["build_session", "checkpoint_dir", "cut_lineage"]
