"""The shared folder, lineage cuts and the size of Arrow batches, as the operators here use them."""

from arachne.shared import cut, shared_dir, small_batches

__all__ = ["cut", "shared_dir", "small_batches"]
