"""Keyed-log analytics on PySpark: last-write-wins state, compaction, value separation, manifests, pruning and sketches."""
