"""Landing payloads incrementally. The operators themselves are the batch ones."""
