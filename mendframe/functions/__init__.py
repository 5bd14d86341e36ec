"""Part of mendframe; see the package README."""
