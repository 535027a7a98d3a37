"""Part of assetlens."""
