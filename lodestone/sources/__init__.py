"""sources of lodestone."""
