"""Catalogue search, ranking evaluation and catalogue upkeep as Spark DataFrame jobs."""

from labelgrid.session import build_session, shared_folder

__all__ = ["build_session", "shared_folder"]
