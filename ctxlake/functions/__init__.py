"""Part of ctxlake."""
