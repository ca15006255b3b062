"""Part of lodestrata."""
