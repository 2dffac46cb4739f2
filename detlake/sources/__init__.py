"""Readers: protocols, listings, indexes, histories, waveforms, feature tables."""
