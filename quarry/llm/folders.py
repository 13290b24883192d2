"""Folders that Spark wrote, opened by pyarrow in a task."""

from quarry.sources.folders import arrow_uri, open_folder  # noqa: F401
