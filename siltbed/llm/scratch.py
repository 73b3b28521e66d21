"""Tables that cut lineage; see the library's own module."""

from ..sources.scratch import drop, folder, written

__all__ = ["drop", "folder", "written"]
