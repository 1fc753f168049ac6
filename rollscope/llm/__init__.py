"""Training-data operators: near duplicates, sharding, packing, quality, PII, token counts,
embeddings, mixing, language, web archives.  Nothing outside this subpackage imports it."""
