"""Spark jobs for post activity, shared links, reshares, audience similarity and opinion exposure."""
