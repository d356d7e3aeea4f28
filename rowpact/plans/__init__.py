"""Reference workloads: derived frames, registered queries and their SQL counterparts."""
