"""Where this subpackage keeps intermediate tables."""

from patchloom.sources.saved import saved, shared_folder

__all__ = ["saved", "shared_folder"]
