"""Reading, caching, checkpoints, manifests, codebooks, settings and report sinks."""
