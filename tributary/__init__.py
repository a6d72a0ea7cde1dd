"""Source-dependency analytics over many repositories at once, as Spark jobs.

Every operator takes DataFrames and returns a DataFrame.  All tables lead with
the repository key ``(repo, commit_sha)``, so one job covers a whole corpus.
"""

from tributary.session import KEYS

__all__ = ["KEYS"]
