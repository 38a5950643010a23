"""Factor library and the plan that evaluates many factors together."""
