"""Part of locusframe."""
