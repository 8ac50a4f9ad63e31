"""Named queries over the snapshot tables, by subject."""
