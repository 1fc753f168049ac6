from rollscope.sources import files  # noqa: F401  first: the file table builds on it
