"""Part of tracequarry."""
