"""Part of lexigrid; see README."""
