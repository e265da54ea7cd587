"""Part of the measure engine."""
