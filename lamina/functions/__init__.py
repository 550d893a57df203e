"""Part of lamina."""
