"""The library's shared tables, under the name by which the operators know them."""

from tidemark.storage import Workspace, delete, shared_root, shuffle_cleanup

__all__ = ["Workspace", "delete", "shared_root", "shuffle_cleanup"]
