"""Where documents, settings and prompts come from."""
