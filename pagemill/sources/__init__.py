"""Tables on shared storage: landing pages, chunks, snapshots, logs."""
