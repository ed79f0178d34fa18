"""Reading and writing: raw messages, the event store, catalogs, alert tables."""
