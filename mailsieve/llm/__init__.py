"""Training-data operators: secrets, tokens, duplicates, fingerprints, search, packing,
chat templates and language identification.  Nothing outside this folder imports it."""
