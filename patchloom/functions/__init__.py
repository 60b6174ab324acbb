"""Part of patchloom."""
